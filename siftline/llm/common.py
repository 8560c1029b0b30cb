"""What the training-data operators share: scratch tables, byte views of text columns,
partition prefix sums.

Cutting lineage.  ``materialize`` writes a Parquet table under the folder that the cluster
names in ``spark.checkpoint.dir`` and reads it back.  Every executor sees that folder, so a
lost executor costs only its running tasks, and each task's output is committed whole.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python task; a longer single text is one slice.
SLICE_BYTES = 4 << 20
#: ``[^\x20\x09-\x0D]+`` is a word everywhere here; ``bytes.split()`` cuts at exactly these.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors share."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # one machine, as in tests
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="siftline-")
        found = _own_dir
    found = found.rstrip("/")
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all that operators left in the shared folder.  Results not yet written are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siftline")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_hash(key: Column, modulus: int) -> Column:
    """crc32(key as text) mod ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


_caches: dict[str, Callable[[], object]] = {}
_entered: str | None = None


def cached(owner: str, clear: Callable[[], object]) -> None:
    """Say how to empty what ``owner`` keeps in a Python worker between tasks."""
    _caches[owner] = clear


def enter(owner: str) -> None:
    """Empty what other operators left in this worker, and give their memory back.

    Spark reuses workers from stage to stage; so one holds one operator's caches at a time.
    """
    global _entered
    if owner == _entered:
        return
    for other, clear in _caches.items():
        if other != owner:
            clear()
    if _entered is not None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    _entered = owner


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` text bytes, or one row; empty batches are skipped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array([0 if v is None else v for v in pc.binary_length(batch.column(text)).to_pylist()])
        lo, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += int(n)
        yield batch.slice(lo)


def partition_offsets(df: DataFrame, part: str, count: str) -> dict[int, int]:
    """First pass of a two-pass prefix sum: exclusive prefix sums of the totals of each
    partition, in partition order.

    The driver holds one number for each task that the scheduler already tracks, whatever the
    number of rows.
    """
    totals = sorted((r[0], r[1]) for r in df.groupBy(part).agg(F.sum(count)).collect())
    out, at = {}, 0
    for p, n in totals:
        out[p] = at
        at += n
    return out
