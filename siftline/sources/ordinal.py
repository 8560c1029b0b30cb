"""Dense numbers in a global order, by committed files.

Rows are dealt to ranges of the order, sorted, and written: every file is a run, and no two files
overlap.  Its number of rows and its first key are read from the files; prefix sums over the files in
order of their first keys give each its first number; a row's number is that plus its place in its
file, which Parquet knows.  Nothing rests on partition numbers, which two plans need not agree on.
Two rows for each file are gathered in one place, none of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.sources import shared

_FILE, _PLACE, _BEGIN = "_ordinal_file", "_ordinal_place", "_ordinal_begin"


def numbered(rows: DataFrame, order: str | Sequence[str], name: str = "ordinal", descending: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``name``, a dense number from 0 in the order of the columns ``order``.

    Those also named in ``descending`` count backwards.  Null comes first, or last where it is
    descending.  Rows of equal order get different numbers, in no stated order among them.
    """
    keys = [order] if isinstance(order, str) else list(order)
    sort = lambda prefix="": [F.desc(prefix + k) if k in descending else F.asc(prefix + k) for k in keys]
    path = shared.fresh(rows.sparkSession, "runs")
    rows.repartitionByRange(*sort()).sortWithinPartitions(*sort()).write.option("compression", "zstd").parquet(path)
    runs = rows.sparkSession.read.schema(rows.schema).parquet(path)
    runs = runs.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_PLACE))
    counts = runs.groupBy(_FILE).agg(F.count(F.lit(1)).alias("_ordinal_n"))
    firsts = runs.filter(F.col(_PLACE) == 0).select(_FILE, *(F.col(k).alias(f"_ordinal_{k}") for k in keys))
    # a writer that cuts a run of equal keys into several files names them in turn
    before = F.sum("_ordinal_n").over(Window.orderBy(*sort("_ordinal_"), _FILE).rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.join(firsts, _FILE).select(_FILE, F.coalesce(before, F.lit(0)).alias(_BEGIN))
    own = [c for c in rows.columns if c != name]
    return runs.join(F.broadcast(begins), _FILE).select(*own, (F.col(_BEGIN) + F.col(_PLACE)).alias(name))
