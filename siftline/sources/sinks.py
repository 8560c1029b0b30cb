"""Where results go: JSON lines, CSV, tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite", single: bool = False) -> None:
    """JSON lines in ``order``; ``single`` gathers them in one file, for exports of bounded size."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if single else out).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], order: Sequence[str] = ()) -> None:
    """Header, the given fields in turn, missing ones empty, white space kept; arrays and maps as JSON."""
    kinds = dict(df.dtypes)
    out = df.orderBy(*order) if order else df
    columns = []
    for f in fields:
        if f not in kinds:
            columns.append(F.lit("").alias(f))
        elif kinds[f].startswith(("array", "map", "struct")):
            columns.append(F.to_json(f).alias(f))
        else:
            columns.append(F.col(f))
    out.select(*columns).write.mode("overwrite").options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def summary_json(row: DataFrame) -> str:
    """A one-row frame as indented JSON."""
    return json.dumps(row.first().asDict(recursive=True), ensure_ascii=False, indent=2)


def import_articles(found: DataFrame, table: str, replace: bool = True) -> int:
    """Write articles to a table sorted by rank within files, so that ranges of rank prune.

    Without ``replace`` their ids go on from the highest that the table holds.
    """
    spark = found.sparkSession
    if not replace and spark.catalog.tableExists(table):
        last = spark.table(table).agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first().last
        found = found.withColumn("id", F.col("id") + F.lit(last))
    found.sortWithinPartitions(F.desc("rank_score")).write.mode("overwrite" if replace else "append").format("parquet").saveAsTable(table)
    return spark.table(table).count()
