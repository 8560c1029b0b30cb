"""Substring search by a trigram index.

``build`` writes three tables below a folder:

* ``texts``: id and searched text, in folders of ``span`` ids;
* ``postings``: (gram, id) for every distinct run of three characters of a text.  Rows are dealt to files by
  ranges of (bucket, gram, id): a gram that every text has is spread over files, and a file's least and
  greatest gram tell whether it can hold another;
* ``grams``: in how many texts each gram is.

A search reads the counts of its own grams, the postings of the rarest few, and the texts of the ids that
have all of these, which alone can hold the searched text; each is then looked through.  So the result is
that of a scan.  A searched text of fewer than three characters has no gram and is scanned for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 3
#: Ids that share a folder of texts, folders of postings, and grams that a search looks up.
SPAN, BUCKETS, RAREST = 1000, 16, 4


def grams(blob: Column) -> Column:
    """Distinct runs of three characters, overlapping ones too."""
    return F.array_distinct(F.regexp_extract_all(blob, F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build(found: DataFrame, blob: Column, path: str, id: str = "id", span: int = SPAN, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Index ``blob`` by ``id``, a whole number from 0.  ``mode`` append adds rows of new ids.

    The texts are written first and the postings made of them, so ``found`` is read once.
    """
    spark = found.sparkSession
    texts = found.select(F.col(id).cast("long").alias("id"), blob.alias("blob"))
    parted = texts.withColumn("part", F.floor(F.col("id") / span))
    parted.repartitionByRange("part", "id").sortWithinPartitions("part", "id").write.mode(mode).partitionBy("part").parquet(f"{path}/texts")
    kept = spark.read.parquet(f"{path}/texts")
    if mode == "append":
        kept = kept.join(found.select(F.col(id).cast("long").alias("id")), "id", "left_semi")
    each = kept.select(F.explode(grams(F.col("blob"))).alias("gram"), "id").withColumn("bucket", _bucket(F.col("gram"), buckets))
    each.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counted.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    spark.createDataFrame([(span, buckets)], "span long, buckets int").write.mode("overwrite").parquet(f"{path}/layout")


def _of(wanted: list[str], buckets: int) -> Column:
    """Rows of these grams: folders are picked by bucket, files and pages by gram."""
    return reduce(lambda a, b: a | b, ((F.col("bucket") == _bucket(F.lit(g), buckets)) & (F.col("gram") == g) for g in wanted))


def candidates(spark: SparkSession, path: str, q: str, rarest: int = RAREST) -> DataFrame | None:
    """(id) of all texts that can hold ``q``; None where every text can."""
    wanted = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
    if not wanted:
        return None
    buckets = spark.read.parquet(f"{path}/layout").first().buckets
    # one row for each gram of the searched text
    counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/grams").filter(_of(wanted, buckets)).select("gram", "n").collect()}
    postings = spark.read.parquet(f"{path}/postings")
    if len(counts) < len(wanted):
        return postings.select("id").limit(0)
    rare = sorted(wanted, key=lambda g: (counts[g], g))[:rarest]
    held = postings.filter(_of(rare, buckets)).select("id", "gram")
    return held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select("id")


def folders(spark: SparkSession, path: str, found: DataFrame) -> list[int]:
    """The folders of texts that have one of the ids ``found``: one number each comes to the driver."""
    span = spark.read.parquet(f"{path}/layout").first().span
    return sorted(r.part for r in found.select(F.floor(F.col("id") / span).alias("part")).distinct().collect())


def texts_with(spark: SparkSession, path: str, q: str, rarest: int = RAREST) -> DataFrame:
    """(id, blob) of the texts that hold ``q``, which is looked for as it stands."""
    texts = spark.read.parquet(f"{path}/texts")
    if (found := candidates(spark, path, q, rarest)) is not None:
        # other folders are not opened
        texts = texts.filter(F.col("part").isin(folders(spark, path, found))).join(found, "id", "left_semi")
    return texts.filter(F.col("blob").contains(q)).select("id", "blob")
