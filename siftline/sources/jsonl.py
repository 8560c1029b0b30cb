"""JSON lines with their text kept: ``raw`` STRING, ``v`` VARIANT and the line's place.

Unknown members survive in ``raw``, and ``v`` tells a missing member from a null one.

Numbering.  A file is read in splits, by several tasks.  One pass checks each line and counts,
within its split, the lines and the objects before it; its result is written.  A second pass sums
both over the splits that come before, by file and offset: so every line has its number in its
file and every object a dense ordinal over all files, without a sort, and both are of committed files
and not of a plan that may be cut otherwise when it runs again.

What counts as JSON is what Python's decoder takes: NaN and infinities pass, and of a repeated member
the last value counts.  VARIANT knows neither, so ``v`` is parsed from a text in which such
numbers are the texts "NaN", "Infinity" and "-Infinity" and each member stands once; of such lines
``raw`` is that text too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.batches import slices
from siftline.sources import shared

LINES = "file string, block long, id long, raw string"
CHECKED = f"{LINES}, kind string, bad string, plain string, at long, nth long"


class MalformedLine(ValueError):
    """A line that is no JSON, in strict reading."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as splits of files have them, blank ones too."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))


class _Decoder:
    """Python's decoder, which also says whether a text holds what stricter readers refuse."""

    def __init__(self):
        self.lax = False
        self.decode = json.JSONDecoder(object_pairs_hook=self._object, parse_constant=self._constant).decode

    def _object(self, pairs: list[tuple[str, object]]) -> dict:
        found = dict(pairs)
        self.lax = self.lax or len(found) < len(pairs)
        return found

    def _constant(self, name: str) -> str:
        self.lax = True
        return name

    def read(self, raw: str) -> tuple[str, str | None, str | None]:
        """(kind, what is wrong, the text that VARIANT can read, where it differs)."""
        self.lax = False
        try:
            value = self.decode(raw)
        except (ValueError, RecursionError) as e:
            return "bad", str(e) or type(e).__name__, None
        if not isinstance(value, dict):
            return "other", None, None
        return "object", None, json.dumps(value) if self.lax else None


def checked(lines: DataFrame) -> DataFrame:
    """Lines (file, block, id, raw) with ``kind`` (object, other, bad or blank), of bad ones what is
    wrong, and the numbers of lines and of objects before them in their split (file, block).

    The lines of a split are expected to come in turn, as a scan gives them.  Some 2 MB of lines, or one
    line, are Python objects at a time.
    """

    names = [part.split()[0] for part in LINES.split(", ")]
    kinds = {"kind": pa.string(), "bad": pa.string(), "plain": pa.string(), "at": pa.int64(), "nth": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, split, at, nth = _Decoder(), None, 0, 0
        for batch in slices(batches, "raw"):
            found = []
            for file, block, raw in zip(*(batch.column(n).to_pylist() for n in ("file", "block", "raw")), strict=True):
                if (file, block) != split:
                    split, at, nth = (file, block), 0, 0
                text = (raw or "").strip()
                kind, bad, plain = decoder.read(text) if text else ("blank", None, None)
                found.append((kind, bad, plain, at, nth))
                at += 1
                nth += kind == "object"
            new = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], [*names, *kinds])

    return lines.mapInArrow(run, CHECKED)


def placed(found: DataFrame) -> DataFrame:
    """Checked lines, as they were written, with ``line`` (from 1, in their file) and ``ordinal``
    (from 0, over the objects of all files).  One row for each split is summed in one place."""
    counts = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind") == "object").alias("objects"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("file", "block", F.coalesce(F.sum("lines").over(in_file), F.lit(0)).alias("_line"), F.coalesce(F.sum("objects").over(in_all), F.lit(0)).alias("_object"))
    return found.join(F.broadcast(begins), ["file", "block"]).withColumns({"line": F.col("_line") + F.col("at") + 1, "ordinal": F.col("_object") + F.col("nth")})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its place, kind and, of bad ones, what is wrong; checked once and written."""
    return placed(shared.written(checked(_lines(spark, path)), "lines"))


def _objects(found: DataFrame) -> DataFrame:
    raw = F.coalesce("plain", "raw")
    return found.filter("kind = 'object'").select("file", "block", "id", "line", "ordinal", raw.alias("raw"), F.try_parse_json(raw).alias("v"))


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Objects (file, line, ordinal, raw, v) of JSONL files; a missing file is empty, a malformed
    line is an error that names the file and the line, the first one in order."""
    if not shared.exists(spark, path):
        return _objects(placed(spark.createDataFrame([], CHECKED)))
    found = read(spark, path)
    bad = found.filter("kind = 'bad'").orderBy("file", "line").select("file", "line", "raw", "bad").first()
    if bad is not None:
        raise MalformedLine(f"{bad.file}:{bad.line}: {bad.bad}: {bad.raw[:80]}")
    return _objects(found)


def read_lenient(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(objects, malformed lines with file, line and reason); a missing file is an error."""
    if not shared.exists(spark, path):
        raise FileNotFoundError(path)
    found = read(spark, path)
    return _objects(found), found.filter("kind = 'bad'").select("file", "line", "raw", "bad")


def count(spark: SparkSession, path: str) -> int:
    return read_strict(spark, path).count()


def field(name: str, kind: str = "string"):
    """A member of ``v`` as a column."""
    return F.try_variant_get(F.col("v"), f"$.{name}", kind)
