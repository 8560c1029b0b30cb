"""Packing by concatenating and cutting.

Pass one tokenizes each partition, numbers its tokens locally and writes the ids; the totals of
the partitions give, by prefix sum, the global offset of each partition.  Pass two cuts the
concatenation at every multiple of the window and yields one boundary record for each piece.
No sequence is padded but the last.

Defined results: a null text is empty and still gets its end token; repeated rows are packed
once each; an empty table gives no pieces; columns of any other name are ignored; a text longer
than a window becomes several pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common, wordtok

WINDOW = 2048
END_ID = 1

TOKENS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part_id", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())]
)


def tokenize(docs: DataFrame, tokenizer: str, end: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids (little-endian unsigned 32-bit) of each row, numbered within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, at = wordtok.for_path(tokenizer), TaskContext.get().partitionId(), 0
        for batch in common.slices(batches, "text", wordtok.TEXT_BYTES):
            ids, sizes = tok.encode(common.as_bytes(batch.column("text")), end)
            edges = np.concatenate(([0], np.cumsum(sizes)))
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(sizes), part, np.int64)),
                    pa.array(at + edges[:-1]),
                    pa.array(sizes.astype(np.int64)),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                ],
                TOKENS.names,
            )
            at += int(edges[-1])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, TOKENS)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence.

    ``start`` counts the document's ids before the piece, ``sequence_id`` and ``offset`` place
    it, ``doc_tokens`` counts the document's ids with the end id.  ``ids`` holds the piece
    itself unless ``with_ids`` is false.
    """
    if window < 1:
        raise ValueError("window must be positive")
    tokens = common.materialize(tokenize(docs, tokenizer, end, key, text), "pack-tokens")
    offsets = common.partition_offsets(tokens, "part_id", "n_tokens")
    names = PIECES.names if with_ids else PIECES.names[:-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "ids"):
            out: list[tuple] = []
            for doc, part, local, n, ids in zip(*(batch.column(c).to_pylist() for c in TOKENS.names), strict=True):
                begin = offsets[part] + local
                at = begin
                while at < begin + n:
                    stop = min(begin + n, (at // window + 1) * window)
                    piece = ids[4 * (at - begin) : 4 * (stop - begin)]
                    out.append((doc, at - begin, stop - at, zlib.crc32(piece), n, at // window, at % window, piece))
                    at = stop
            columns = list(zip(*out, strict=True))[: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return tokens.mapInArrow(cut, T.StructType([PIECES[n] for n in names]))


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves: ids in order, and where each document's piece begins.

    A group is one sequence, so it never holds more than a window of ids.
    """
    piece = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    return packed.groupBy("sequence_id").agg(piece.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["start"])).alias("boundaries"),
    )
