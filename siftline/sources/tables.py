"""The papers view over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as tx

TITLE_CHARS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as papers: doc_id, title, abstract, keywords, venue, year, url."""
    docs = table(spark, sf_dir, "documents").withColumn("_clean", tx.clean_text(F.col("text")))
    return docs.select(
        "doc_id",
        F.substring("_clean", 1, TITLE_CHARS).alias("title"),
        F.col("text").alias("abstract"),
        F.col("lang").alias("keywords"),
        F.col("source").alias("venue"),
        (F.lit(2018) + F.col("doc_id") % 8).cast("int").alias("year"),
        F.concat(F.lit("https://papers.example/"), (F.col("doc_id") % 700).cast("string")).alias("url"),
    )
