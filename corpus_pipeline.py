"""From raw documents to packed training sequences.

Every stage works on all rows that the one before kept.  All but the last return the columns of
``documents``; ``run`` writes each stage's rows to the shared folder and rereads them, so no
stage is computed twice and a lost executor costs its running tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import common, cotrain, langid, mixing, neardup, packing, registry, wordtok

#: Least pooled probability of the predicted language.  Of 3,409 labelled clean documents (sf0.1) the
#: lowest is at 0.3006; 0.5 would reject four of them, texts of a word or two.
LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with hardly a trace of any language, go."""
    found = langid.identify(docs)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together call bad go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.classify(docs, labels).filter("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each component, of the smallest id; rows that are linked with nothing all
    stay, but that rows of the same id and text are one document."""
    found = neardup.classify(docs, by_text=True).filter("kept")
    # rows of one id may have several texts: one text of each component, each text without shingles
    kept = found.groupBy("doc_id", F.coalesce(F.col("linked").cast("string"), "text_hash").alias("of")).agg(F.min("text_hash").alias("text_hash"))
    kept = found.join(kept.drop("of").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_text")), "left_semi")
    kept = common.materialize(kept.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")), "pipeline-kept")
    wanted = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_kept"))
    hashed = docs.withColumn("_text", neardup.text_hash(F.col("text")))
    out = hashed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_kept")), "left_semi")
    repeated = kept.filter("rows > 1").limit(1).count()
    return (out.dropDuplicates(["doc_id", "_text"]) if repeated else out).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at their source's rate, in random order."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences."""
    return packing.pieces(docs, wordtok.vocabulary(registry.VOCABULARY), with_ids=False)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The language network and the classifier have no SQL form; tests/llm hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
