"""Line-first cleaning with DataFrame functions only.

Each line of a text stands three rules in turn:

* punctuation: more than a quarter of its characters, white space aside, are noise, that is
  characters that prose has no use for and doubled marks; or it has ``UNENDED_WORDS`` words or more
  and shows no mark that ends or parts a sentence in any of the scripts of ``SENTENCE``.  Quotes,
  dashes, brackets and the marks of a sentence are no noise, so dialogue stays, and as characters
  are counted and not words, so do scripts without spaces;
* navigation: ``SEPARATORS`` or more words are nothing but menu separators, or separators are a
  quarter of its words; a closing quote is none where the line opens one;
* boilerplate: notices, such as of licences, cookies or copyright, make up ``NOTICE_SHARE``
  hundredths or more of a line of at most ``NOTICE_CHARS`` characters, so that prose that speaks
  of a policy stays.  What calls upon the reader ("read more") counts where a line begins with it.

Failing lines are removed, and a document that loses more than half of its characters goes.
Counts over the whole text stand beside the verdict.

Repeated three-word windows are found in the row itself: windows are hashed, sorted with their
places, and runs of equal hashes mark the places; one pass over those counts the words they
cover.  Nothing is shuffled, and no step is quadratic in the length of a text.  Hashes have 64
bits and are not confirmed by the words: of a text of a million windows, two unlike ones share a
hash with a chance of 3 in 100 million, and their six words at most would count as repeated.

Defined results: a null text has no words or lines and fails; lines are cut at ``\\n`` and only
lines with a word count; rows are judged each alone, so repeats and ties do not matter; an
empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word and a run of white space, in both regular-expression dialects; symbols.
WORD, SPACE, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", "#*$%&|<>"
#: Marks of prose in common scripts; those of them that end or part a sentence.
PROSE = r".,;:!?…\x27\x22“”‘’«»‹›„‚()¿¡\-–—·、。，；：！？「」『』（）《》〈〉・।॥؟،؛۔։።"
SENTENCE = r"[.!?;:…。！？；：।॥؟؛۔։።]"
DOUBLED = r"!!+|\?\?+|,,+|;;+"
#: Neither letter, number, white space nor mark of prose; or marks that are doubled.
PLAIN = rf"a-zA-Z\p{{L}}\p{{M}}\p{{N}}\p{{Z}}\p{{Cf}}\x09-\x0D{PROSE}"
NOISE = rf"[^{PLAIN}]|{DOUBLED}"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|·>/](?=[\x20\x09-\x0D]|$)"
CLOSING = r"(?:^|[\x20\x09-\x0D])»(?=[\x20\x09-\x0D]|$)"
#: Most of a line's characters that may be noise, as one in so many.
NOISE_PART = 4
UNENDED_WORDS = 12
SEPARATORS = 3
#: Most of a text's characters that cleaning may remove, in hundredths.
MOST_LOST = 50
MIN_WORDS, MOST_REPEATED = 50, 50
#: Least share of a line, in hundredths, that notices make up; characters of the longest such line.
NOTICE_SHARE, NOTICE_CHARS = 20, 400
#: Phrases of notices, lower case.
NOTICES = (
    "all rights reserved",
    "copyright ©",
    "© ",
    "(c) 19",
    "(c) 20",
    "cookie policy",
    "uses cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "released under the",
    "licensed under",
    "public license",
    "powered by",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "verwendet cookies",
    "tous droits réservés",
    "politique de confidentialité",
    "utilise des cookies",
    "todos los derechos reservados",
    "política de privacidad",
    "utiliza cookies",
)
#: What calls upon the reader, lower case.
CALLS = (
    "click here",
    "read more",
    "sign up for",
    "subscribe to",
    "log in to",
    "enable javascript",
    "please enable javascript",
    "skip to content",
)


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _without(text: Column, characters: str) -> Column:
    """A text without the given characters: one search for each, which finds none in most texts."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _shape_fails(line: Column) -> Column:
    """Punctuation and navigation.  Most lines have nothing odd and show a mark: two searches."""
    words = F.size(words_of(line))
    noise = F.length(line) - F.length(F.regexp_replace(line, NOISE, ""))
    solid = F.length(F.regexp_replace(line, SPACE, ""))
    bars = _count(line, SEPARATOR) + F.when(line.contains("«"), 0).otherwise(_count(line, CLOSING))
    odd = (noise * NOISE_PART > solid) | (bars >= SEPARATORS) | (bars * 4 >= F.greatest(words, F.lit(1)))
    # what a line must hold for noise or separators; a run of plain letters is passed over at once,
    # which is far cheaper than a search for NOISE
    some = ~line.rlike(rf"^(?:[a-zA-Z ,.]++|[{PLAIN}])*+$")
    for n in ("·", "»", "!!", "??", ",,", ";;"):
        some = some | line.contains(n)
    return (~line.rlike(SENTENCE) & (words >= UNENDED_WORDS)) | (some & odd)


def _notice_fails(line: Column) -> Column:
    def share(low: Column) -> Column:
        found = F.lit(0)
        for n in NOTICES:
            found = found + F.when(low.contains(n), len(n)).otherwise(0)
        for n in CALLS:
            found = found + F.when(low.startswith(n), len(n)).otherwise(0)
        return found * 100 >= F.length(low) * NOTICE_SHARE

    # an array of one, so that the lower-cased line is worked out once
    return (F.length(line) <= NOTICE_CHARS) & F.exists(F.array(F.lower(F.btrim(line))), share)


def line_fails(line: Column) -> Column:
    """Whether a line stands against any of the rules."""
    return _shape_fails(line) | _notice_fails(line)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``words`` an array column."""
    return F.expr(
        f"""
        aggregate(
          sort_array(transform(
            filter(_windows, (x, i) -> get(_windows, i - 1).h = x.h OR get(_windows, i + 1).h = x.h),
            x -> x.i)),
          named_struct('n', 0, 'e', 0),
          (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.e), 'e', p + 3),
          a -> a.n)
        """
    )


def inspect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the characters and lines before and after."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(WORD)))
    hashed = F.expr("slice(transform(_words, (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2))), 1, greatest(size(_words) - 2, 0))")
    rows = rows.withColumn("_hashes", hashed).withColumn("_kept_lines", F.filter("_lines", lambda x: ~line_fails(x)))
    # sorting is for texts that repeat a window; the rest are told apart by a hash set
    windows = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.expr("sort_array(transform(_hashes, (h, i) -> named_struct('h', h, 'i', i)))"))
    rows = rows.withColumn("_windows", windows)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    counted = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_windows").isNotNull(), repeated_words(F.col("_words"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_kept_lines").cast("long").alias("n_lines_kept"),
        total("_lines").alias("line_chars"),
        total("_kept_lines").alias("line_chars_kept"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    clean = (F.col("line_chars") - F.col("line_chars_kept")) * 100 <= F.col("line_chars") * MOST_LOST
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & clean)


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the failing lines of ``text`` removed (null stays null)."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(WORD) & ~line_fails(x))
    return docs.withColumn(text, F.array_join(lines, "\n"))


def _sql_notices() -> str:
    found = [f"CASE WHEN contains(low, '{n}') THEN {len(n)} ELSE 0 END" for n in NOTICES]
    return " + ".join(found + [f"CASE WHEN starts_with(low, '{n}') THEN {len(n)} ELSE 0 END" for n in CALLS])


#: DuckDB's form of ``inspect`` over ``documents``.
ORACLE = rf"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS words FROM rows),
each AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM w),
counts AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM each GROUP BY r),
win AS (
  SELECT a.r, a.i, a.w AS w1, b.w AS w2, c.w AS w3
  FROM each a JOIN each b ON a.r = b.r AND b.i = a.i + 1 JOIN each c ON a.r = c.r AND c.i = a.i + 2),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM rep, range(3) AS g(d) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM rows),
worded AS (SELECT r, line, lower(trim(line, ' ')) AS low FROM lines WHERE regexp_matches(line, '{WORD}')),
judged AS (
  SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS words,
    length(line) - length(regexp_replace(line, '{NOISE}', '', 'g')) AS noise,
    length(regexp_replace(line, '{SPACE}', '', 'g')) AS solid,
    NOT regexp_matches(line, '{SENTENCE}') AS bare,
    len(list_filter(regexp_extract_all(line, '{WORD}'), lambda w: w IN ('|', '·', '>', '/') OR (w = '»' AND NOT contains(line, '«')))) AS bars,
    length(line) <= {NOTICE_CHARS} AND ({_sql_notices()}) * 100 >= length(low) * {NOTICE_SHARE} AS notice
  FROM worded),
verdict AS (
  SELECT *, (noise * {NOISE_PART} > solid OR (words >= {UNENDED_WORDS} AND bare) OR bars >= {SEPARATORS}
    OR bars * 4 >= greatest(words, 1) OR notice) AS fails FROM judged),
per AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (NOT fails) AS n_lines_kept,
    sum(length(line)) AS line_chars, coalesce(sum(length(line)) FILTER (NOT fails), 0) AS line_chars_kept,
    count(*) - count(DISTINCT line) AS n_dup_lines
  FROM verdict GROUP BY r),
out AS (
  SELECT rows.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines_kept, 0)::BIGINT AS n_lines_kept,
    coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(line_chars_kept, 0)::BIGINT AS line_chars_kept
  FROM rows LEFT JOIN counts USING (r) LEFT JOIN cov USING (r) LEFT JOIN per USING (r))
SELECT *, (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED}) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED})
  AND (line_chars - line_chars_kept) * 100 <= line_chars * {MOST_LOST} AS kept
FROM out
"""
