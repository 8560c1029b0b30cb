"""The subpackage's queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bitslice, bytebpe, cotrain, dac, fim, langid, lattice, linedist, lineclean, matroska, mixing, neardup, packing, wordtok

VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated to weights of source size to the power 0.5, shuffled."""
    return mixing.mix(_documents(spark, sf_dir))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice scores of every document."""
    return lattice.score(_documents(spark, sf_dir), wordtok.vocabulary(PIECES))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.classify(_documents(spark, sf_dir))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(_documents(spark, sf_dir), carry=["doc_id"])


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return linedist.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary records of windows of 2048 ids."""
    return packing.pieces(_documents(spark, sf_dir), wordtok.vocabulary(VOCABULARY), with_ids=False)


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and line-first verdict of every document."""
    return lineclean.inspect(_documents(spark, sf_dir))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files in directly addressable codes, described from the files."""
    return dac.round_trip(_documents(spark, sf_dir), wordtok.vocabulary(VOCABULARY))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a Matroska media column, described from its parsed packets."""
    return matroska.round_trip(_documents(spark, sf_dir))


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from both views."""
    return cotrain.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=["doc_id"])


def op11_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return bitslice.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document, and what they decode to."""
    return bytebpe.round_trip(_documents(spark, sf_dir), wordtok.vocabulary(RANKS), bytebpe.pattern())


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, and the text restored from it."""
    return fim.digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lattice": op2_lattice,
    "op3_neardup": op3_neardup,
    "op4_langid": op4_langid,
    "op5_html_text": op5_html_text,
    "op6_packing": op6_packing,
    "op7_line_rules": op7_line_rules,
    "op8_token_ids": op8_token_ids,
    "op9_matroska": op9_matroska,
    "op10_cotraining": op10_cotraining,
    "op11_bit_sliced": op11_bit_sliced,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fim": op13_fim,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op7_line_rules": lineclean.ORACLE,
    "op11_bit_sliced": bitslice.ORACLE,
    "op13_fim": fim.ORACLE,
}
