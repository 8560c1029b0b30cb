"""Fill-in-middle transformation in column expressions.

Units.  ``regexp_extract_all`` cuts a text into its units from left to right (by default code
points); ``unit`` may be any expression whose matches cover a text whole, such as ``(?s)\\w+|\\W``.
Cuts.  Four 8-digit groups of the hex sha256 of ``seed:id`` are read as unsigned integers h1 to
h4.  With n units, the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle
after the larger, and the suffix is the rest.
Arrangement.  A text stays plain if it is empty, has a sentinel in it or h3 % 100 is not below
``rate``; else its suffix comes first (spm) if h4 % 100 is below ``spm``, or its prefix (psm)::

    psm  <P>prefix<S>suffix<M>middle        spm  <S>suffix<P>prefix<M>middle

``restored`` parses the sentinels.  No part has one in it, and none can arise where a part meets a
sentinel (each begins with its only ``<`` and ends with its only ``>``), so an arranged text has
exactly three.

Defined results: a null text is empty, and so plain; a null id counts as empty text in the hash;
repeated rows give repeated rows; an empty table stays empty; columns of the input that are named
like a new one, or begin with ``_fim``, give way, all others stay; a long text is cut whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Texts of a hundred that are arranged, and arranged ones of a hundred with the suffix first.
RATE, SPM = 90, 20
UNIT, SEED = "(?s).", "1"
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"


def draws(seed: str, key: Column, n: int = 4) -> list[Column]:
    """The first ``n`` 8-digit groups of the hash of ``seed:key`` as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def _checked(sentinels: Sequence[str]) -> list[str]:
    found = list(sentinels)
    if len(found) != 3 or len(set(found)) != 3 or any(len(s) < 3 or s[0] != "<" or s[-1] != ">" or "<" in s[1:] or ">" in s[:-1] for s in found):
        raise ValueError("sentinels are three different texts that begin with their only < and end with their only >")
    return found


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, sentinels: Sequence[str] = SENTINELS, unit: str = UNIT, seed: str = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix_chars and middle_chars (null if plain) and output."""
    p, s, m = _checked(sentinels)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    own = [c for c in docs.columns if c not in new and not c.startswith("_fim")]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = docs.select(*own, F.regexp_extract_all(whole, F.lit(unit), F.lit(0)).alias("_fim_units"), *(h.alias(f"_fim_h{i}") for i, h in enumerate(draws(seed, F.col(key)), 1)))
    n = F.size("_fim_units")
    ends = [F.col(f"_fim_h{i}") % (n + 1) for i in (1, 2)]
    has = F.col(text).cast("string").contains(p) | F.col(text).cast("string").contains(s) | F.col(text).cast("string").contains(m)
    plain = (n == 0) | F.coalesce(has, F.lit(False)) | (F.col("_fim_h3") % 100 >= rate)
    form = F.when(plain, PLAIN).when(F.col("_fim_h4") % 100 < spm, SUFFIX_FIRST).otherwise(PREFIX_FIRST)
    cut = cut.select(*own, "_fim_units", form.alias("form"), F.least(*ends).cast("int").alias("_fim_a"), F.greatest(*ends).cast("int").alias("_fim_b"))
    part = lambda lo, hi: F.array_join(F.slice("_fim_units", lo + 1, hi - lo), "")
    a, b = F.col("_fim_a"), F.col("_fim_b")
    arranged = F.col("form") != PLAIN
    parts = cut.select(
        *own,
        n.cast("long").alias("n"),
        "form",
        # of plain texts no part is made
        F.when(arranged, part(F.lit(0), a)).alias("_fim_prefix"),
        F.when(arranged, part(a, b)).alias("_fim_middle"),
        F.when(arranged, part(b, n)).alias("_fim_suffix"),
    )
    prefix, middle, suffix = (F.col(f"_fim_{x}") for x in ("prefix", "middle", "suffix"))
    output = (
        F.when(F.col("form") == PREFIX_FIRST, F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .when(F.col("form") == SUFFIX_FIRST, F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
        .otherwise(whole)
    )
    return parts.select(*own, "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an arrangement was made of, from it and its form alone."""
    found = F.split(output, "|".join(rf"\Q{s}\E" for s in _checked(sentinels)), -1)
    first, second, middle = (F.get(found, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == PREFIX_FIRST, F.concat(first, middle, second)).when(form == SUFFIX_FIRST, F.concat(second, middle, first)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """Forms, sizes and hashes of every arranged and of every restored text."""
    made = transform(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_P, _S, _M = SENTINELS
#: DuckDB's form of ``digests`` over ``documents``.
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, {", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '{_P}') OR contains(text, '{_S}') OR contains(text, '{_M}') OR h3 % 100 >= {RATE} THEN '{PLAIN}'
    WHEN h4 % 100 < {SPM} THEN '{SUFFIX_FIRST}' ELSE '{PREFIX_FIRST}' END AS form FROM d),
c AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> '{PLAIN}' THEN a END AS prefix_chars, CASE WHEN form <> '{PLAIN}' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN '{PREFIX_FIRST}' THEN '{_P}' || prefix || '{_S}' || suffix || '{_M}' || middle
    WHEN '{SUFFIX_FIRST}' THEN '{_S}' || suffix || '{_P}' || prefix || '{_M}' || middle ELSE text END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256 FROM c
"""
