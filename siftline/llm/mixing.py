"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is ``weight * total / documents of the source``.  Each
document's count of copies inverts the Poisson distribution of that mean at a uniform number
hashed from its key, so the count depends on nothing but the key, the seed and the rate.  The
document is exploded by its count, and the copies are dealt out and ordered by a second hash:
a global shuffle that any run repeats.

All of it is DataFrame expressions.  Only one row for each source is joined to the documents;
it is broadcast after counting the sources, and joined by shuffle where they are many (Spark
then splits a hot source).

Defined results: a null source is a source of its own; a null key hashes as the text "null";
rows with equal keys get equal counts; a source without weight is left out of the mix; an empty
table stays empty; other columns are carried through (``n_copies``, ``copy`` and
``shuffle_key`` replace columns of those names).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import materialize

SEED = "mix-1"
#: Target weights follow the size of the source to this power where none are given.
EXPONENT = 0.5
#: Rates from which a table leaves out what lies far below the mean.
FROM_ZERO = 1000
#: More sources than this, or more numbers in all their tables (16 MB), are joined by shuffle.
BROADCAST_SOURCES, BROADCAST_NUMBERS = 10_000, 2 << 20


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from an md5 of the parts."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_tables(rated: DataFrame) -> DataFrame:
    """``rated`` (_mix_source, _mix_rate) with ``_mix_low`` and ``_mix_cdf``: the distribution
    function at ``_mix_low``, ``_mix_low`` + 1, ... as far as a double can tell from 1.

    Below ``_mix_low``, some twelve deviations under the mean, lies nothing that 52 bits could
    hit, so a table has about 24 square roots of the rate.  Sums of logarithms, so no rate
    underflows.
    """
    rate = F.col("_mix_rate")
    spread = F.sqrt(rate) * 12 + 40
    low = F.when(rate < FROM_ZERO, 0).otherwise(F.floor(rate - spread)).cast("long")
    bounds = rated.withColumn("_mix_low", low).withColumn("_k", F.explode(F.sequence(F.col("_mix_low"), (rate + spread).cast("long"))))
    n, k = F.col("_mix_low").cast("double"), F.col("_k")
    # log probability at the lower end: Stirling's series where that is not 0
    begin = F.when(n == 0, -rate).otherwise((n - rate) + n * F.ln(rate / n) - F.ln(n * (2 * math.pi)) / 2 - 1 / (n * 12) + 1 / (n * n * n * 360))
    upto = Window.partitionBy("_mix_source").orderBy("_k")
    logs = bounds.withColumn("_lp", F.sum(F.when(k == F.col("_mix_low"), begin).otherwise(F.ln(rate) - F.ln(k.cast("double")))).over(upto))
    at = logs.withColumn("_at", F.sum(F.exp("_lp")).over(upto))
    table = at.groupBy("_mix_source", "_mix_rate", "_mix_low").agg(F.array_sort(F.collect_list(F.struct("_k", "_at"))).alias("_t"))
    return table.select("_mix_source", "_mix_rate", "_mix_low", F.col("_t._at").alias("_mix_cdf"))


def rates(docs: DataFrame, source: str = "source", weights: dict | None = None, total: float | None = None, exponent: float = EXPONENT) -> DataFrame:
    """One row for each source with a weight: its mean repetition rate and the Poisson table."""
    sizes = docs.groupBy(F.col(source).alias("_mix_source")).agg(F.count(F.lit(1)).alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(exponent))))
    else:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("weights must be numbers from 0")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "k string, weight double")
        weighted = sizes.join(given, F.col("_mix_source").cast("string").eqNullSafe(F.col("k"))).drop("k")
    sums = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    wanted = F.col("all_size").cast("double") if total is None else F.lit(float(total))
    rate = F.col("weight") * wanted / (F.col("all_weight") * F.col("size"))
    out = weighted.filter(F.col("weight") > 0).join(F.broadcast(sums)).select("_mix_source", rate.alias("_mix_rate"))
    return poisson_tables(out)


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    total: float | None = None,
    exponent: float = EXPONENT,
    seed: str = SEED,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Copies of ``docs`` in expected proportion to ``weights``, in random order.

    ``weights``: of each source, by name; None for size to the power ``exponent``.  ``total``:
    expected number of rows out, by default as many as came in.
    """
    own = [c for c in docs.columns if c not in ("n_copies", "copy", "shuffle_key")]
    table = materialize(rates(docs, source, weights, total, exponent), "mix-rates")
    held = table.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum(F.size("_mix_cdf")), F.lit(0)).alias("numbers")).first()
    if held.sources <= BROADCAST_SOURCES and held.numbers <= BROADCAST_NUMBERS:
        table = F.broadcast(table)
    u = uniform(seed, F.col(key))
    drawn = docs.select(*own).join(table, F.col(source).eqNullSafe(F.col("_mix_source"))).withColumn("_mix_u", u)
    passed = F.aggregate("_mix_cdf", F.col("_mix_low").cast("int"), lambda n, c: n + F.when(c <= F.col("_mix_u"), 1).otherwise(0))
    counted = drawn.withColumn("_mix_n", passed)
    copies = counted.filter("_mix_n > 0").select(*own, F.col("_mix_n").alias("n_copies"), F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    shuffled = copies.withColumn("shuffle_key", order)
    return shuffled.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


#: DuckDB's form of ``mix`` with the defaults, over ``documents``.
ORACLE = f"""
WITH sizes AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(size::DOUBLE, {EXPONENT}) AS weight FROM sizes),
rated AS (
  SELECT source, weight * (SELECT sum(size) FROM weighted)::DOUBLE
                 / ((SELECT sum(weight) FROM weighted) * size) AS rate
  FROM weighted),
bounds AS (
  SELECT source, rate, CASE WHEN rate < {FROM_ZERO} THEN 0 ELSE floor(rate - sqrt(rate) * 12 - 40) END::BIGINT AS low,
    trunc(rate + sqrt(rate) * 12 + 40)::BIGINT AS high FROM rated),
steps AS (SELECT source, rate, low, low::DOUBLE AS n, unnest(generate_series(low, high)) AS k FROM bounds),
logs AS (
  SELECT source, low, k, sum(CASE WHEN k > low THEN ln(rate) - ln(k::DOUBLE) WHEN low = 0 THEN -rate
      ELSE (n - rate) + n * ln(rate / n) - ln(n * (2 * pi())) / 2 - 1 / (n * 12) + 1 / (n * n * n * 360) END)
    OVER (PARTITION BY source ORDER BY k) AS lp FROM steps),
cdf AS (SELECT source, low, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS p FROM logs),
tables AS (SELECT source, low, list(p ORDER BY k) AS cdf FROM cdf GROUP BY source, low),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
    / {float(1 << 52)} AS u, t.cdf, t.low
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, (low + len(list_filter(cdf, lambda c: c <= u)))::INTEGER AS n_copies FROM drawn)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy::INTEGER AS copy,
  md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM counted WHERE n_copies > 0)
"""
