"""Named queries over the driver tables, each with its SQL twin.

The judge's answers are synthesised from ``doc_id`` on the half-point grid, so that no engine's
rounding shows.  ``labels`` is the set of papers that are done.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import errors, scores
from siftline.functions import text as tx
from siftline.functions.overlay import overlaid
from siftline import profile
from siftline.operators import judge, keywords, portal, ranking, rules, textindex
from siftline.sources import jsonl, shared, sinks
from siftline.sources.articletable import ArticleTable
from siftline.sources.tables import TITLE_CHARS, papers, table
from siftline.streaming import runner

POSITIVE = ("the and", "tion", "of the", "inon", "er the", "queé", "und der", "ation")
NEGATIVE = ("worthless", "der die", "lorem", "http")
YEARS = (2020, 2023)
TARGET, MIN_SCORE = 100, 1.0
DIMENSIONS = {"transfer_value": 2.0, "method_novelty": 1.2, "feasibility": 1.0}
NOTE_WORDS = 240

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# -- SQL building blocks ------------------------------------------------------------------

_WHITE = r"[\s\x1c-\x1f\x85\pZ]+"
_CLEAN = f"trim(regexp_replace(coalesce(%s, ''), '{_WHITE}', ' ', 'g'))"
_PAPERS = f"""
papers AS (
  SELECT doc_id, substr({_CLEAN % "text"}, 1, {TITLE_CHARS}) AS title, text AS abstract, lang AS keywords,
    source AS venue, (2018 + doc_id % 8)::INTEGER AS year, 'https://papers.example/' || (doc_id % 700) AS url
  FROM documents)"""
_BLOB = f"""
blobs AS (
  SELECT *, lower({_CLEAN % "title"} || ' ' || {_CLEAN % "abstract"} || ' ' || {_CLEAN % "keywords"}) AS blob FROM papers)"""


def _points_sql(words: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains(blob, '{w}') THEN {1.5 if ' ' in w else 1.0} ELSE 0 END" for w in words)


def _hits_sql(words: tuple[str, ...]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN contains(blob, '{w}') THEN '{w}' END" for w in words) + ")"


_SCORED = f"""{_PAPERS},{_BLOB},
points AS (
  SELECT *, ({_points_sql(POSITIVE)})::DOUBLE AS rule_positive_score, ({_points_sql(NEGATIVE)})::DOUBLE AS rule_negative_score,
    {_hits_sql(POSITIVE)} AS positive_hits, {_hits_sql(NEGATIVE)} AS negative_hits FROM blobs),
scored AS (SELECT *, round(rule_positive_score - 1.25 * rule_negative_score, 4) AS rule_score FROM points)"""

_FIT, _NOVELTY = "((doc_id * 7) % 21) / 2.0", "((doc_id * 11) % 20) / 2.0"
_DIM_SQL = {"transfer_value": "((doc_id * 13) % 19) / 2.0", "method_novelty": "((doc_id * 17) % 21) / 2.0", "feasibility": "((doc_id * 5) % 18) / 2.0"}
_MEAN_SQL = "(" + " + ".join(f"{_DIM_SQL[k]} * {w}" for k, w in DIMENSIONS.items()) + f") / {sum(DIMENSIONS.values())}"
_RAW_PRIORITY = "CASE doc_id % 5 WHEN 0 THEN ' KEEP ' WHEN 1 THEN 'maybe' WHEN 2 THEN 'Drop' WHEN 3 THEN 'later' END"
_PRIORITY = f"CASE WHEN lower(trim({_RAW_PRIORITY})) IN ('keep', 'maybe', 'drop') THEN lower(trim({_RAW_PRIORITY})) ELSE 'maybe' END"
_JUDGED = f"""{_PAPERS},
judged AS (
  SELECT *, ({_FIT})::DOUBLE AS score_overall_fit, ({_NOVELTY})::DOUBLE AS score_theory_novelty,
    {", ".join(f"({s})::DOUBLE AS score_{k}" for k, s in _DIM_SQL.items())},
    {_PRIORITY} AS priority,
    round(0.45 * ({_FIT})::DOUBLE + 0.40 * ({_MEAN_SQL})::DOUBLE + 0.15 * ({_NOVELTY})::DOUBLE, 4) AS rank_score,
    'idea ' || (doc_id % 97) AS idea_core, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'mechanism ' || (doc_id % 31) END AS transferable_mechanism,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'fits ' || (doc_id % 13) END AS fit_reason, 'risk ' || (doc_id % 7) AS risk_or_limitation
  FROM papers)"""
_ARTICLES = f"""{_JUDGED},
articles AS (
  SELECT doc_id + 1 AS id, title, coalesce(abstract, '') AS abstract, coalesce(venue, '') AS venue, year, url, '' AS authors, priority,
    '' AS profile_name, idea_core, transferable_mechanism, coalesce(fit_reason, '') AS fit_reason, risk_or_limitation,
    rank_score, score_overall_fit, score_theory_novelty, score_transfer_value, score_method_novelty, score_feasibility
  FROM judged)"""


def query(name: str, sql: str):
    """Register a query and its twin."""

    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return register


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score(papers(spark, sf_dir), POSITIVE, NEGATIVE)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with a judge's cleaned, blended answers."""
    rows = papers(spark, sf_dir)
    half = lambda k, m: (F.col("doc_id") * k % m / 2.0).cast("double")
    dims = {"transfer_value": half(13, 19), "method_novelty": half(17, 21), "feasibility": half(5, 18)}
    raw = F.element_at(F.array(*(F.lit(p) for p in (" KEEP ", "maybe", "Drop", "later", None))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = rows.withColumns(
        {
            "score_overall_fit": scores.clamp(half(7, 21)),
            "score_theory_novelty": scores.clamp(half(11, 20)),
            **{f"score_{k}": scores.clamp(c) for k, c in dims.items()},
            "priority": scores.priority(raw),
            "idea_core": F.concat(F.lit("idea "), (F.col("doc_id") % 97).cast("string")),
            "transferable_mechanism": F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("mechanism "), (F.col("doc_id") % 31).cast("string"))),
            "fit_reason": F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("fits "), (F.col("doc_id") % 13).cast("string"))),
            "risk_or_limitation": F.concat(F.lit("risk "), (F.col("doc_id") % 7).cast("string")),
        }
    )
    own = {k: F.col(f"score_{k}") for k in DIMENSIONS}
    mean = scores.weighted_mean(own, DIMENSIONS)
    return rows.withColumns(
        {
            "scores": F.create_map(*(x for k, c in own.items() for x in (F.lit(k), c))),
            "rank_score": scores.rank_score(F.col("score_overall_fit"), mean, F.col("score_theory_novelty")),
        }
    )


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portal.articles(_judged(spark, sf_dir))


# -- text and keys ------------------------------------------------------------------------


@query("clean_text", f"SELECT doc_id, {_CLEAN % 'text'} AS clean FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query(
    "clean_text_truncated",
    f"SELECT doc_id, CASE WHEN length(c) > 240 THEN substr(c, 1, 240) || ' ...' ELSE c END AS clean FROM (SELECT doc_id, {_CLEAN % 'text'} AS c FROM documents)",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text"), 240).alias("clean"))


_KEY_SQL = "CASE WHEN doc_id % 3 = 0 THEN 'url::' || url ELSE 'sha1::' || sha1(title || '::' || venue || '::' || year) END"


@query("paper_key", f"WITH {_PAPERS} SELECT doc_id, {_KEY_SQL} AS paper_key FROM papers")
def _(spark, sf):
    return _keyed(papers(spark, sf)).select("doc_id", "paper_key")


def _keyed(rows: DataFrame) -> DataFrame:
    """Two papers of three have no url and are keyed by digest."""
    part = rows.withColumn("url", F.when(F.col("doc_id") % 3 == 0, F.col("url")))
    return part.withColumn("paper_key", tx.paper_key(part.columns, F.col("title"), F.col("venue"), F.col("year")))


# -- rule filter --------------------------------------------------------------------------


@query("rule_score", f"WITH {_SCORED} SELECT doc_id, rule_positive_score, rule_negative_score, rule_score FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("doc_id", "rule_positive_score", "rule_negative_score", "rule_score")


@query("rule_hits", f"WITH {_SCORED} SELECT doc_id, positive_hits, negative_hits FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("doc_id", F.concat_ws("|", "rule_positive_hits").alias("positive_hits"), F.concat_ws("|", "rule_negative_hits").alias("negative_hits"))


@query("year_filter", f"WITH {_PAPERS} SELECT doc_id, year FROM papers WHERE year IN {YEARS}")
def _(spark, sf):
    return rules.in_years(papers(spark, sf), YEARS).select("doc_id", "year")


@query("min_score_keep", f"WITH {_SCORED} SELECT doc_id, rule_score FROM scored WHERE rule_score >= {MIN_SCORE}")
def _(spark, sf):
    return rules.kept(_scored(spark, sf), MIN_SCORE).select("doc_id", "rule_score")


@query("min_score_reject", f"WITH {_SCORED} SELECT doc_id, rule_score FROM scored WHERE NOT rule_score >= {MIN_SCORE}")
def _(spark, sf):
    return rules.rejected(_scored(spark, sf), MIN_SCORE).select("doc_id", "rule_score")


@query("dedup_first_wins", "SELECT min(doc_id) AS doc_id, sha1(text) AS content_key FROM documents GROUP BY sha1(text)")
def _(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("content_key"))
    return rules.first_wins(keyed, "content_key", "doc_id").select("doc_id", "content_key")


@query(
    "dedup_by_paper_key",
    f"""WITH {_PAPERS}, k AS (SELECT doc_id, {_KEY_SQL} AS paper_key FROM papers)
SELECT min(doc_id) AS doc_id, paper_key FROM k GROUP BY paper_key""",
)
def _(spark, sf):
    return rules.first_wins(_keyed(papers(spark, sf)), "paper_key", "doc_id").select("doc_id", "paper_key")


_PLACED = f"""{_SCORED},
placed AS (SELECT *, row_number() OVER (ORDER BY rule_score DESC, title DESC, doc_id) AS place FROM scored WHERE rule_score >= {MIN_SCORE})"""


@query("filter_top_n", f"WITH {_PLACED} SELECT doc_id, title, rule_score FROM placed WHERE place <= {TARGET}")
def _(spark, sf):
    return rules.kept(_scored(spark, sf), MIN_SCORE, TARGET).select("doc_id", "title", "rule_score")


@query(
    "filter_overflow_union",
    f"""WITH {_PLACED} SELECT doc_id, rule_score, 'overflow' AS part FROM placed WHERE place > {TARGET}
UNION ALL SELECT doc_id, rule_score, 'below' FROM scored WHERE NOT rule_score >= {MIN_SCORE}""",
)
def _(spark, sf):
    return rules.rejected(_scored(spark, sf), MIN_SCORE, TARGET).select("doc_id", "rule_score", "part")


@query(
    "filter_summary",
    f"""WITH {_SCORED}, n AS (SELECT count(*) AS n, least(count(*) FILTER (rule_score >= {MIN_SCORE}), {TARGET}) AS k FROM scored)
SELECT 'catalog' AS profile, k::BIGINT AS kept, (n - k)::BIGINT AS rejected FROM n""",
)
def _(spark, sf):
    return rules.summary(_scored(spark, sf), "catalog", MIN_SCORE, TARGET)


@query("venue_year_counts", f"WITH {_PLACED} SELECT venue || '::' || year AS venue_year, count(*) AS n FROM placed WHERE place <= {TARGET} GROUP BY 1")
def _(spark, sf):
    return rules.venue_years(rules.kept(_scored(spark, sf), MIN_SCORE, TARGET))


@query("resume_anti_join", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf):
    key = F.col("doc_id").cast("string").alias("paper_key")
    return runner.pending(table(spark, sf, "documents").select("doc_id", key), table(spark, sf, "labels").select(key)).select("doc_id")


@query("head_limit", f"WITH {_PAPERS} SELECT doc_id, year FROM papers WHERE year IN {YEARS} ORDER BY doc_id LIMIT 50")
def _(spark, sf):
    return runner.selected(papers(spark, sf), YEARS, 50).select("doc_id", "year")


@query(
    "keyword_cross",
    f"""WITH {_PAPERS},{_BLOB}, k(keyword) AS (VALUES {", ".join(f"('{w}')" for w in POSITIVE + NEGATIVE)})
SELECT keyword, count(*) AS n_papers FROM k, blobs WHERE contains(blob, keyword) GROUP BY keyword""",
)
def _(spark, sf):
    return rules.keyword_counts(papers(spark, sf), POSITIVE + NEGATIVE)


#: 1,000 syllable pairs, a fifth of them to each of five profiles; those that end in "nu" count against.
_ONSETS, _VOWELS, _SECOND = "bcdfghjklmnpqrstvwxz", "aeiou", "tn"
_SYLLABLES_SQL = f"""
k AS (SELECT 'profile ' || b AS profile, a || b || c || d AS keyword, c || d = 'nu' AS negative
  FROM (SELECT unnest(string_split('{_ONSETS}', '')) AS a), (SELECT unnest(string_split('{_VOWELS}', '')) AS b),
    (SELECT unnest(string_split('{_SECOND}', '')) AS c), (SELECT unnest(string_split('{_VOWELS}', '')) AS d))"""


def _syllable_profiles() -> list[profile.Profile]:
    pairs = [(a + b + c + d, b, c + d == "nu") for a in _ONSETS for b in _VOWELS for c in _SECOND for d in _VOWELS]
    words = lambda b, negative: tuple(k for k, v, n in pairs if v == b and n == negative)
    return [profile.Profile(f"profile {b}", positive_keywords=words(b, False), negative_keywords=words(b, True), scoring_dimensions=(profile.Dimension("x", "x"),)) for b in _VOWELS]


@query("keyword_hits", f"WITH {_PAPERS},{_BLOB},{_SYLLABLES_SQL} SELECT profile, keyword, negative, doc_id FROM k, blobs WHERE contains(blob, keyword)")
def _(spark, sf):
    return keywords.hits(papers(spark, sf), _syllable_profiles())


@query(
    "profile_scores",
    f"""WITH {_PAPERS},{_BLOB},{_SYLLABLES_SQL}
SELECT doc_id, profile AS profile_name, count(*) FILTER (NOT negative AND contains(blob, keyword))::DOUBLE AS rule_positive_score,
  count(*) FILTER (negative AND contains(blob, keyword))::DOUBLE AS rule_negative_score,
  round(count(*) FILTER (NOT negative AND contains(blob, keyword)) - 1.25 * count(*) FILTER (negative AND contains(blob, keyword)), 4)::DOUBLE AS rule_score
FROM k, blobs GROUP BY doc_id, profile""",
)
def _(spark, sf):
    return keywords.score(papers(spark, sf), _syllable_profiles(), carry=["doc_id"]).drop("rule_positive_hits", "rule_negative_hits")


# -- judge --------------------------------------------------------------------------------


@query(
    "prompt_payload",
    f"""WITH {_SCORED}, c AS (SELECT *, {_CLEAN % "abstract"} AS a FROM scored)
SELECT doc_id, trim(title) || '|' || (CASE WHEN length(a) > 3000 THEN substr(a, 1, 3000) || ' ...' ELSE a END) || '|' || venue || '|' || year || '|' || url AS payload, rule_score FROM c""",
)
def _(spark, sf):
    rows = _scored(spark, sf)
    fields = judge.prompt_paper(rows.columns)
    return rows.select("doc_id", F.concat_ws("|", *(fields[n] for n in ("title", "abstract", "venue", "year", "url"))).alias("payload"), fields["rule_score"].alias("rule_score"))


@query(
    "extract_json",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 11 END AS fit,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'n' || (doc_id % 5) END AS note FROM documents""",
)
def _(spark, sf):
    n = F.col("doc_id")
    body = F.concat(F.lit('{"fit": '), (n % 11).cast("string"), F.lit(', "note": "n'), (n % 5).cast("string"), F.lit('"}'))
    noisy = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("Well { so: "), body, F.lit(" bye"))).when(n % 4 == 2, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.lit("no { object"))
    v = tx.first_json_object(noisy)
    found = table(spark, sf, "documents").select("doc_id", v.alias("v"))
    return found.select("doc_id", F.try_variant_get("v", "$.fit", "bigint").alias("fit"), F.try_variant_get("v", "$.note", "string").alias("note"))


@query(
    "clamp_scores",
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE least(10.0, greatest(0.0, n_chars / 500.0 - 3)) END::DOUBLE AS score FROM documents",
)
def _(spark, sf):
    # a number as text, from the length; every seventh is none
    raw = F.concat((F.col("n_chars") / 500.0 - 3).cast("string"), F.when(F.col("doc_id") % 7 == 0, "/10").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", scores.clamp(tx.to_double(raw, None)).alias("score"))


@query("normalize_priority", f"SELECT doc_id, {_PRIORITY} AS priority FROM documents")
def _(spark, sf):
    return _judged(spark, sf).select("doc_id", "priority")


@query(
    "truthy_flag",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN n_chars % 3 <> 0 WHEN 1 THEN n_chars % 2 = 1 WHEN 2 THEN n_chars % 2 = 0 WHEN 3 THEN coalesce(source <> '', false) ELSE false END AS is_suitable
FROM documents""",
)
def _(spark, sf):
    # a number, a string of one character or none, true or false, the source as a string, null
    n = F.col("n_chars")
    raw = F.when(F.col("doc_id") % 5 == 0, (n % 3).cast("string")).when(F.col("doc_id") % 5 == 1, F.when(n % 2 == 1, '"x"').otherwise('""'))
    raw = raw.when(F.col("doc_id") % 5 == 2, (n % 2 == 0).cast("string")).when(F.col("doc_id") % 5 == 3, F.concat(F.lit('"'), "source", F.lit('"'))).otherwise("null")
    return table(spark, sf, "documents").select("doc_id", tx.truthy_text(raw).alias("is_suitable"))


@query("weighted_profile_score", f"SELECT doc_id, round(({_MEAN_SQL})::DOUBLE, 4) AS profile_score FROM documents")
def _(spark, sf):
    own = {k: F.col(f"score_{k}") for k in DIMENSIONS}
    return _judged(spark, sf).select("doc_id", F.round(scores.weighted_mean(own, DIMENSIONS), 4).alias("profile_score"))


@query("rank_score", f"WITH {_JUDGED} SELECT doc_id, score_overall_fit, score_theory_novelty, rank_score FROM judged")
def _(spark, sf):
    return _judged(spark, sf).select("doc_id", "score_overall_fit", "score_theory_novelty", "rank_score")


@query("flatten_scores", f"WITH {_JUDGED} SELECT doc_id, {', '.join(f'score_{k}' for k in DIMENSIONS)} FROM judged")
def _(spark, sf):
    rows = _judged(spark, sf).select("doc_id", "scores")
    return rows.select("doc_id", *(F.col("scores")[k].alias(f"score_{k}") for k in DIMENSIONS))


_NEEDLES = (*errors.AUTH, *errors.QUOTA, "segmentation fault", "401", "unauthorized")
_MESSAGE_SQL = f"lower(coalesce(substr(text, 1, 40), '') || ' ' || CASE doc_id % {len(_NEEDLES)} {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NEEDLES))} END || CASE WHEN n_chars % 2 = 0 THEN '; Rate Limit' ELSE '' END)"


def _any_sql(needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(m, '{n}')" for n in needles) + ")"


@query("error_classify", f"WITH t AS (SELECT doc_id, {_MESSAGE_SQL} AS m FROM documents) SELECT doc_id, CASE WHEN {_any_sql(errors.AUTH)} THEN 'auth' WHEN {_any_sql(errors.QUOTA)} THEN 'quota' ELSE 'other' END AS error_class FROM t")
def _(spark, sf):
    # the start of a text, a needle of either class or what is none, and now and then a second one
    needle = F.element_at(F.array(*(F.lit(n.title()) for n in _NEEDLES)), (F.col("doc_id") % len(_NEEDLES) + 1).cast("int"))
    text = F.concat(F.coalesce(F.substring("text", 1, 40), F.lit("")), F.lit(" "), needle, F.when(F.col("n_chars") % 2 == 0, "; Rate Limit").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", errors.classify(text).alias("error_class"))


PROFILE = profile.Profile("catalog", scoring_dimensions=tuple(profile.Dimension(k, k, w) for k, w in DIMENSIONS.items()))


def _stub(prompt: str) -> str:
    """A judge whose scores follow from the paper's url; it fails for every twentieth."""
    n = int(re.search(r"papers.example/(\d+)", prompt)[1])
    if n % 20 == 19:
        raise RuntimeError("usage limit reached" if n % 40 == 19 else "connection reset")
    answer = {"is_suitable": "false" if n % 3 else "", "priority": ("Keep", " drop", "later")[n % 3], "score_overall_fit": n * 7 % 25 / 2, "score_theory_novelty": str(n * 11 % 20 / 2), "scores": {"transfer_value": n * 13 % 19 / 2, "method_novelty": None}, "method_novelty": 9, "feasibility": n * 5 % 18 / 2}
    return ("```json\n%s\n```", "Well { so: %s bye", "%s")[n % 3] % json.dumps(answer)


@query(
    "judge_replies",
    f"""WITH n AS (SELECT doc_id, doc_id % 700 AS n FROM documents),
s AS (SELECT doc_id, n, n % 20 <> 19 AS ok, least(10, n * 7 % 25 / 2.0) AS fit, n * 11 % 20 / 2.0 AS novelty, n * 13 % 19 / 2.0 AS a, n * 5 % 18 / 2.0 AS c FROM n)
SELECT doc_id, CASE WHEN ok THEN 'none' WHEN n % 40 = 19 THEN 'quota' ELSE 'other' END AS failure, ok AND n % 3 <> 0 AS is_suitable,
  CASE WHEN ok THEN CASE n % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' ELSE 'maybe' END ELSE 'maybe' END AS priority,
  CASE WHEN ok THEN fit ELSE 0 END::DOUBLE AS score_overall_fit, 0::DOUBLE AS score_method_novelty, CASE WHEN ok THEN c ELSE 0 END::DOUBLE AS score_feasibility,
  CASE WHEN ok THEN round(0.45 * fit + 0.4 * (a * 2.0 + c) / 4.2 + 0.15 * novelty, 4) ELSE 0 END::DOUBLE AS rank_score FROM s""",
)
def _(spark, sf):
    # the result needs no other column of the papers, so none goes through Python
    asked = judge.ask(judge.prompts(papers(spark, sf), PROFILE).select("doc_id", "prompt"), _stub, max_retries=2, retry_sleep=0)
    found = judge.judged(asked, PROFILE, "stub")
    failure = F.when(F.col("error").isNull(), "none").otherwise(errors.classify(F.col("error"))).alias("failure")
    return found.select("doc_id", failure, "is_suitable", "priority", "score_overall_fit", "score_method_novelty", "score_feasibility", "rank_score")


@query(
    "pending_after_failures",
    """SELECT doc_id, CASE WHEN doc_id % 700 % 40 = 19 THEN 'quota' ELSE 'other' END AS failure FROM
  (SELECT min(doc_id) AS doc_id FROM documents WHERE (2018 + doc_id % 8) IN (2021, 2023) GROUP BY doc_id % 700) WHERE doc_id % 700 % 20 = 19""",
)
def _(spark, sf):
    # papers of two years, the first of each url; those that the stub fails for are pending still
    todo = runner.keyed(runner.selected(papers(spark, sf), (2021, 2023)))
    asked = shared.written(judge.ask(judge.prompts(runner.pending(todo, None), PROFILE), _stub, max_retries=1), "asked")
    failed = asked.filter("error IS NOT NULL").select("doc_id", errors.classify(F.col("error")).alias("failure"))
    return runner.pending(todo, asked.filter("error IS NULL")).select("doc_id").join(failed, "doc_id")


@query(
    "progress_position",
    f"""WITH {_PAPERS} SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, count(*) OVER () AS total, doc_id % 700 % 3 = 0 AS skipped, md5(coalesce(abstract, '')) AS text_md5 FROM papers WHERE year IN {YEARS}""",
)
def _(spark, sf):
    # every third url is done; papers that share it are skipped, but have their places
    rows = runner.keyed(papers(spark, sf))
    # and the text comes along
    placed = runner.positions(runner.selected(rows, YEARS), rows.filter("doc_id < 700 AND doc_id % 3 = 0"))
    return placed.select("doc_id", "position", "total", "skipped", F.md5(F.coalesce("abstract", F.lit("")).cast("binary")).alias("text_md5"))


@query(
    "jsonl_lines",
    """SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'other' WHEN 2 THEN 'other' ELSE 'object' END AS kind,
  CASE WHEN doc_id % 5 > 2 THEN source END AS title, CASE WHEN doc_id % 5 > 2 THEN n_chars END AS n FROM documents""",
)
def _(spark, sf):
    # cut short, in an array, a bare number, whole
    whole = F.to_json(F.struct(F.col("source").alias("title"), F.col("n_chars").alias("n")))
    n = F.col("doc_id") % 5
    raw = F.when(n == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(n == 1, F.concat(F.lit("["), whole, F.lit("]"))).when(n == 2, F.col("n_chars").cast("string")).otherwise(whole)
    lines = table(spark, sf, "documents").select(F.lit("documents").alias("file"), F.lit(0).cast("long").alias("block"), F.col("doc_id").cast("long").alias("id"), raw.alias("raw"))
    found = jsonl.checked(lines).withColumn("v", F.when(F.col("kind") == "object", F.try_parse_json("raw")))
    return found.select("id", "kind", jsonl.field("title").alias("title"), jsonl.field("n", "bigint").alias("n"))


# -- export and progress ------------------------------------------------------------------

_EXPORT = ("doc_id", "title", "venue", "year", "priority", "rank_score", "score_overall_fit", "score_theory_novelty", *(f"score_{k}" for k in DIMENSIONS))


@query(
    "export_topk",
    f"""WITH {_JUDGED} SELECT row_number() OVER (ORDER BY rank_score DESC, score_overall_fit DESC, score_theory_novelty DESC, doc_id)::INTEGER AS rank,
  {", ".join(_EXPORT)} FROM judged QUALIFY rank <= 100""",
)
def _(spark, sf):
    return ranking.export(_judged(spark, sf), _EXPORT)


@query(
    "portal_ready",
    f"""WITH {_JUDGED} SELECT doc_id, rank_score AS final_score, score_theory_novelty AS theory_novelty, score_overall_fit AS submission_value,
  idea_core AS theory_explanation_zh, transferable_mechanism AS recommendation_zh, coalesce(fit_reason, '') AS fit_reason, risk_or_limitation FROM judged""",
)
def _(spark, sf):
    return ranking.portal_ready(_judged(spark, sf)).select("doc_id", "final_score", "theory_novelty", "submission_value", "theory_explanation_zh", "recommendation_zh", "fit_reason", "risk_or_limitation")


@query("progress_priority", f"SELECT coalesce(p, 'UNKNOWN') AS priority, count(*) AS n FROM (SELECT nullif({_PRIORITY}, 'drop') AS p FROM documents) GROUP BY 1")
def _(spark, sf):
    rows = _judged(spark, sf).select(F.when(F.col("priority") != "drop", F.col("priority")).alias("priority"))
    return ranking.priority_counts(rows)


@query(
    "progress_venue_year_top20",
    f"WITH {_PAPERS} SELECT venue, year, count(*) AS n, min(doc_id) AS first_seen FROM papers GROUP BY venue, year ORDER BY n DESC, first_seen LIMIT 20",
)
def _(spark, sf):
    return ranking.top_groups(papers(spark, sf), ("venue", "year"))


@query(
    "progress_averages",
    f"WITH {_JUDGED} SELECT round(avg(rank_score), 3) AS avg_rank_score, round(avg(score_overall_fit), 3) AS avg_score_overall_fit, round(avg(score_theory_novelty), 3) AS avg_score_theory_novelty FROM judged",
)
def _(spark, sf):
    return ranking.averages(_judged(spark, sf))


@query("last_item", f"WITH {_PAPERS} SELECT title FROM papers ORDER BY doc_id DESC LIMIT 1")
def _(spark, sf):
    return ranking.last_value(papers(spark, sf), "title")


# -- portal -------------------------------------------------------------------------------

_ARTICLE = ("id", "title", "abstract", "venue", "year", "url", "authors", "priority", "profile_name", "idea_core", "transferable_mechanism", "fit_reason", "risk_or_limitation", "rank_score", "score_overall_fit", "score_theory_novelty")
_LISTED = ("id", "title", "priority", "year", "rank_score", "score_overall_fit", "score_theory_novelty")


@query("import_articles", f"WITH {_ARTICLES} SELECT {', '.join(_ARTICLE)} FROM articles")
def _(spark, sf):
    return _articles(spark, sf).select(*_ARTICLE)


@query(
    "portal_home",
    f"WITH {_ARTICLES} SELECT count(*) AS total, count(*) FILTER (priority = 'keep') AS keep, round(coalesce(avg(rank_score), 0), 4) AS avg_rank, coalesce(max(rank_score), 0) AS max_rank FROM articles",
)
def _(spark, sf):
    return portal.home(_articles(spark, sf)).withColumn("avg_rank", F.round("avg_rank", 4))


@query("portal_top8", f"WITH {_ARTICLES} SELECT id, title, rank_score FROM articles ORDER BY rank_score DESC, id LIMIT 8")
def _(spark, sf):
    return portal.top_papers(_articles(spark, sf)).select("id", "title", "rank_score")


_LONG = " UNION ALL ".join(f"SELECT id, '{k}' AS key, score_{k} AS value FROM articles" for k in sorted(DIMENSIONS))
_LABELS = "CASE key " + " ".join(f"WHEN '{k}' THEN '{k.replace('_', ' ').title()}'" for k in DIMENSIONS) + " END"


@query(
    "dimension_stats",
    f"WITH {_ARTICLES}, v AS ({_LONG}) SELECT key, {_LABELS} AS label, round(avg(value), 4) AS avg, count(*) FILTER (value >= 7) AS high FROM v GROUP BY key",
)
def _(spark, sf):
    return portal.dimension_stats(_articles(spark, sf)).withColumn("avg", F.round("avg", 4))


@query(
    "dimension_stats_mixed",
    f"""WITH {_ARTICLES}, v AS ({_LONG}), f AS (SELECT id, 'extra_' || (id % 3) AS key, ((id % 21) / 2.0)::DOUBLE AS value FROM articles),
one AS (SELECT key, value FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1),
w AS (SELECT key, value FROM v UNION ALL SELECT key, value FROM one)
SELECT key, round(avg(value), 4) AS avg, count(*) FILTER (value >= 7) AS high FROM w GROUP BY key""",
)
def _(spark, sf):
    flat = F.create_map(F.concat(F.lit("score_extra_"), (F.col("id") % 3).cast("string")), (F.col("id") % 21 / 2.0).cast("double"))
    return portal.dimension_stats(_articles(spark, sf).withColumn("raw_json", F.to_json(flat))).select("key", F.round("avg", 4).alias("avg"), "high")


@query(
    "dimension_stats_nulls",
    f"""WITH {_ARTICLES}, v AS ({_LONG}), w AS (SELECT key, CASE WHEN id % 4 = 0 THEN 0 ELSE value END AS value FROM v WHERE id % 5 <> 0)
SELECT key, round(avg(value), 4) AS avg, count(*) FILTER (value >= 7) AS high FROM w GROUP BY key""",
)
def _(spark, sf):
    # every fourth score is null and counts as 0, every fifth is no number and counts for nothing
    found = _articles(spark, sf).withColumn("m", F.from_json("scores_json", "map<string,double>"))
    odd = F.transform_values("m", lambda k, v: F.when(F.col("id") % 5 == 0, "n/a").when(F.col("id") % 4 != 0, v.cast("string")))
    return portal.dimension_stats(found.withColumn("scores_json", F.to_json(odd, {"ignoreNullFields": "false"})).drop("raw_json")).select("key", F.round("avg", 4).alias("avg"), "high")


_SEARCH_BLOB = "lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in (c for c in portal.SEARCHED if c not in ("theory_bucket", "theory_family"))).replace("nullif(year, '')", "nullif(year, 0)").replace("raw_url", "url") + "))"


@query("portal_search", f"WITH {_ARTICLES} SELECT {', '.join(_LISTED)} FROM articles WHERE contains({_SEARCH_BLOB}, 'ingthe') ORDER BY rank_score DESC, id LIMIT 100")
def _(spark, sf):
    return portal.search(_articles(spark, sf), q=" IngThe ").select(*_LISTED)


@query("portal_search_index", ORACLE_SQL["portal_search"])
def _(spark, sf):
    found = shared.written(_articles(spark, sf), "articles")
    path = shared.fresh(spark, "text-index")
    textindex.build(found, portal.search_blob(found), path)
    return portal.search(found, q=" IngThe ", index=path).select(*_LISTED)


@query("portal_priority", f"WITH {_ARTICLES} SELECT {', '.join(_LISTED)} FROM articles WHERE priority = 'keep' ORDER BY rank_score DESC, id LIMIT 100")
def _(spark, sf):
    return portal.search(_articles(spark, sf), priority="KEEP").select(*_LISTED)


for _mode, _column in portal.SORTS.items():

    @query(f"portal_sort_{_mode.removesuffix('_score')}", f"WITH {_ARTICLES} SELECT {', '.join(_LISTED)} FROM articles ORDER BY {_column} DESC, id LIMIT 100")
    def _(spark, sf, mode=_mode):
        return portal.search(_articles(spark, sf), sort=mode).select(*_LISTED)


@query("article_detail", f"WITH {_ARTICLES} SELECT {', '.join(_ARTICLE)} FROM articles WHERE id = 42")
def _(spark, sf):
    return portal.detail(_articles(spark, sf), 42).select(*_ARTICLE)


@query(
    "portal_display",
    f"""WITH {_ARTICLES} SELECT id, {", ".join(f"coalesce(nullif({c}, ''), 'N/A') AS {c}" for c in ("authors", "venue", "idea_core", "transferable_mechanism", "fit_reason", "risk_or_limitation"))},
  year::VARCHAR AS year, priority, coalesce(nullif(profile_name, ''), 'profile') AS profile_name, coalesce(nullif(abstract, ''), 'No abstract available.') AS abstract,
  idea_core AS summary, round(rank_score::DECIMAL(18, 4), 2)::DECIMAL(18, 2)::VARCHAR AS rank, round(score_overall_fit::DECIMAL(18, 4), 2)::DECIMAL(18, 2)::VARCHAR AS overall FROM articles""",
)
def _(spark, sf):
    return portal.shown(_articles(spark, sf))


@query(
    "score_items",
    f"""WITH {_ARTICLES}, f AS (
  SELECT id, 0 AS place, 'Rank score' AS label, rank_score AS value FROM articles UNION ALL
  SELECT id, 1, 'Overall fit', score_overall_fit FROM articles UNION ALL
  SELECT id, 2, 'Theory novelty', score_theory_novelty FROM articles UNION ALL
  {" UNION ALL ".join(f"SELECT id, {3 + i}, '{k.replace('_', ' ').title()}', score_{k} FROM articles" for i, k in enumerate(sorted(DIMENSIONS)))} UNION ALL
  SELECT id, {3 + len(DIMENSIONS)}, 'Novelty Of Late', (id % 9)::DOUBLE FROM articles)
SELECT id, place::INTEGER AS place, label, value FROM f""",
)
def _(spark, sf):
    # a flat score whose label the map has is left out, another is added
    flat = F.create_map(F.lit("score_feasibility"), F.lit(1.0), F.lit("score_overall_fit"), F.lit(2.0), F.lit("score_novelty_of_late"), (F.col("id") % 9).cast("double"))
    return portal.score_items(_articles(spark, sf).withColumn("raw_json", F.to_json(flat)))


@query("count_papers", "SELECT count(*) AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))


@query("done_keys", "SELECT DISTINCT CASE WHEN doc_id <> 0 THEN 'id::' || doc_id ELSE 'sha1::' || sha1('::::') END AS paper_key FROM labels")
def _(spark, sf):
    return runner.done_keys(table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query(
    "incremental_resume",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 0) WHERE n = 1 "
    "UNION ALL SELECT doc_id, source FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 1) d "
    "WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND sha1(e.text) = sha1(d.text))",
)
def _(spark, sf):
    # two batches arrive in turn; the second skips keys of the first
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha1("text").alias("paper_key"))
    first = runner.pending(docs.filter("doc_id % 2 = 0"), None)
    second = runner.pending(docs.filter("doc_id % 2 = 1"), first)
    return first.select("doc_id", "source").unionByName(second.select("doc_id", "source"))


# -- files, tables, rounds and streams ------------------------------------------------------
#
# Each writes what it reads again to the shared folder.


@query(
    "jsonl_round_trip",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id, md5(coalesce(text, 'none')) AS text_md5, 'object' AS kind FROM documents WHERE doc_id % 50 <> 3
UNION ALL SELECT NULL, doc_id, NULL, 'bad' FROM documents WHERE doc_id % 50 = 3""",
)
def _(spark, sf):
    # a line for each document, blank lines between, every fiftieth cut short; read leniently
    whole = F.to_json(F.struct("doc_id", "text"))
    line = F.concat(F.when(F.col("doc_id") % 50 == 3, F.concat(F.substring_index(whole, ",", 1), F.lit(","))).otherwise(whole), F.when(F.col("doc_id") % 9 == 0, "\n").otherwise(""))
    path = f"{shared.fresh(spark, 'lines')}/all.jsonl"
    table(spark, sf, "documents").select("doc_id", line.alias("value")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    good, bad = jsonl.read_lenient(spark, path)
    good = good.select("ordinal", jsonl.field("doc_id", "bigint").alias("doc_id"), F.md5(F.coalesce(jsonl.field("text"), F.lit("none")).cast("binary")).alias("text_md5"), F.lit("object").alias("kind"))
    cut = F.regexp_extract("raw", r"\d+", 0).cast("long")
    return good.unionByName(bad.select(F.lit(None).cast("long").alias("ordinal"), cut.alias("doc_id"), F.lit(None).cast("string").alias("text_md5"), F.lit("bad").alias("kind")))


@query(
    "jsonl_written_and_counted",
    "SELECT source AS venue, count(*) AS n, (SELECT 2 * count(*) FROM documents) AS total FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents) GROUP BY source",
)
def _(spark, sf):
    # written in order, the same rows appended, read strictly
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("venue"))
    path = shared.fresh(spark, "records")
    sinks.write_jsonl(docs, path, ["doc_id"])
    sinks.append_jsonl(docs, path)
    total = F.lit(jsonl.count(spark, path)).cast("long")
    return jsonl.read_strict(spark, path).groupBy(jsonl.field("venue").alias("venue")).agg(F.count(F.lit(1)).alias("n")).withColumn("total", total)


@query(
    "record_overlay",
    """SELECT doc_id, md5(coalesce(text, 'none')) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE coalesce(lang, 'none') END AS lang, doc_id % 2 = 0 AS laid, 2 AS kept FROM documents""",
)
def _(spark, sf):
    # every second record gets a member that it has and a null one that it has not
    docs = table(spark, sf, "documents").withColumn("raw", F.to_json(F.struct("doc_id", "text", "lang"), {"ignoreNullFields": "false"}))
    laid = overlaid(F.col("raw"), ["lang", "extra"])
    found = docs.withColumn("lang", F.lit("new")).withColumn("extra", F.lit(None).cast("string")).select(F.try_parse_json(F.when(F.col("doc_id") % 2 == 0, laid).otherwise(F.col("raw"))).alias("v"))
    names = F.json_object_keys(F.to_json("v"))
    return found.select(
        jsonl.field("doc_id", "bigint").alias("doc_id"),
        F.md5(F.coalesce(jsonl.field("text"), F.lit("none")).cast("binary")).alias("text_md5"),
        F.coalesce(jsonl.field("lang"), F.lit("none")).alias("lang"),
        F.array_contains(names, "extra").alias("laid"),
        F.size(F.array_intersect(names, F.array(F.lit("doc_id"), F.lit("text")))).alias("kept"),
    )


@query("keep_places", f"WITH {_PLACED} SELECT doc_id, title, rule_score, place - 1 AS place FROM placed")
def _(spark, sf):
    return rules.placed(_scored(spark, sf), MIN_SCORE).select("doc_id", "title", "rule_score", "place")


_CSV = ("rank", "doc_id", "title", "priority", "rank_score", "missing")


@query(
    "csv_export",
    f"""WITH {_JUDGED} SELECT row_number() OVER (ORDER BY rank_score DESC, score_overall_fit DESC, score_theory_novelty DESC, doc_id)::VARCHAR AS rank,
  doc_id::VARCHAR AS doc_id, title, priority, rank_score::VARCHAR AS rank_score, '' AS missing FROM judged""",
)
def _(spark, sf):
    # more rows than one task sorts: ranked by ranges, written, read back as text
    path = shared.fresh(spark, "csv")
    sinks.write_csv(ranking.export(_judged(spark, sf), _EXPORT, rules.GATHERED + 1_000_000), path, _CSV, ["rank"])
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return found.select(*(F.coalesce(c, F.lit("")).alias(c) for c in _CSV))


_ROUNDS_SQL = """n AS (SELECT doc_id, doc_id % 700 AS n FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY doc_id % 700)),
s AS (SELECT doc_id, n, n % 20 <> 19 AS ok, least(10, n * 7 % 25 / 2.0) AS fit, n * 11 % 20 / 2.0 AS novelty, n * 13 % 19 / 2.0 AS a, n * 5 % 18 / 2.0 AS c FROM n)"""


def _rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results and failures of three rounds over the papers, one for each url."""
    path = shared.fresh(spark, "rounds")
    rows = runner.keyed(papers(spark, sf_dir))
    runner.run_until(rows, PROFILE, _stub, f"{path}/done", f"{path}/failed", batch_size=400, max_rounds=3, max_retries=1, sleep=lambda _: None)
    return spark.read.parquet(f"{path}/done"), spark.read.parquet(f"{path}/failed/rows")


@query(
    "judged_rounds",
    f"""WITH {_ROUNDS_SQL} SELECT doc_id, CASE n % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' ELSE 'maybe' END AS priority, fit::DOUBLE AS score_overall_fit,
  round(0.45 * fit + 0.4 * (a * 2.0 + c) / 4.2 + 0.15 * novelty, 4)::DOUBLE AS rank_score FROM s WHERE ok""",
)
def _(spark, sf):
    return _rounds(spark, sf)[0].select("doc_id", "priority", "score_overall_fit", "rank_score")


@query("judged_failures", f"WITH {_ROUNDS_SQL} SELECT doc_id, 'https://papers.example/' || n AS url, CASE WHEN n % 40 = 19 THEN 'quota' ELSE 'other' END AS failure FROM s WHERE NOT ok")
def _(spark, sf):
    # each failed paper as it came, in however many rounds it failed
    return _rounds(spark, sf)[1].select("doc_id", "url", errors.classify(F.col("failure_reason")).alias("failure")).distinct()


@query("stream_resume", "SELECT sha1(text) AS paper_key, min(doc_id % 2) AS batch FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, sf):
    # two loads of files arrive in turn; the second run of the stream skips the keys of the first
    path = shared.fresh(spark, "stream")
    keys = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.sha1("text").alias("paper_key"))
    source = lambda: spark.readStream.schema("paper_key string").option("recursiveFileLookup", "true").parquet(f"{path}/in")
    for load in (0, 1):
        keys.filter(F.col("doc_id") % 2 == load).select("paper_key").write.parquet(f"{path}/in/{load}")
        runner.resume_stream(source(), f"{path}/out", f"{path}/checkpoint", lambda batch: batch)
    return spark.read.parquet(f"{path}/out").select("paper_key", F.col("batch").cast("long").alias("batch"))


def _table(spark: SparkSession, sf_dir: str) -> ArticleTable:
    """A versioned table of all articles, in two loads."""
    found = _articles(spark, sf_dir)
    out = ArticleTable(spark, shared.fresh(spark, "articles"), file_rows=200, index=False)
    # ids are dealt in the order of those that come: the documents' are dense, so they stay
    half = table(spark, sf_dir, "documents").agg((F.max("doc_id") / 2).cast("long")).first()[0]
    out.add(found.filter(F.col("id") <= half))
    out.add(found.filter(F.col("id") > half))
    return out


@query("table_page", ORACLE_SQL["portal_priority"])
def _(spark, sf):
    return _table(spark, sf).page(priority="KEEP").select(*_LISTED)


@query("table_detail", f"WITH {_ARTICLES} SELECT {', '.join(_ARTICLE)} FROM articles WHERE id = 42")
def _(spark, sf):
    return _table(spark, sf).detail(42).select(*_ARTICLE)


@query("table_home", ORACLE_SQL["portal_home"])
def _(spark, sf):
    return _table(spark, sf).home().withColumn("avg_rank", F.round("avg_rank", 4))


@query("table_dimensions", ORACLE_SQL["dimension_stats"])
def _(spark, sf):
    return _table(spark, sf).dimension_stats().withColumn("avg", F.round("avg", 4))
