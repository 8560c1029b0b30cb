"""Token ids in directly addressable codes.

An id is cut into 8-bit chunks, lowest first.  Level 0 holds the first chunk of every id; a bit
for each says whether the id goes on at the next level, where only such ids have a chunk.  A
rank directory counts the set bits before every block of 512, so the place of an id's next
chunk is one directory entry and one popcount away: any id is read without decoding a block.

File, all numbers little-endian::

    magic "DACT"  u16 version  u16 levels  u64 documents  u64 ids
    documents x i64 doc_id, documents x u8 "doc_id is null", (documents + 1) x u64 first id
    for each level: u64 chunks, chunks x u8
                    and, but for the last level: bitmap of ceil(chunks / 8) bytes (lowest bit
                    first), ceil(chunks / 512) x u64 set bits before the block

A file holds a run of documents in ascending order; a manifest row names each complete file.
A retried task writes under a new name, and only the manifest, committed whole by Spark, says
which files count.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common, wordtok

MAGIC, VERSION, BLOCK = b"DACT", 1, 512
#: Ids after which a file is closed: a task holds some 2 bytes for each until then.
FILE_IDS = 8 << 20
END_ID = 2

MANIFEST = T.StructType(
    [
        T.StructField("part_id", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)
DOCS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Encoder:
    """Gathers documents in the form in which the file will have them, some 2 bytes an id."""

    def __init__(self):
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.docs = self.n_ids = 0
        self.chunks: list[bytearray] = []
        self.bitmaps: list[bytearray] = []
        #: the bits, fewer than 8, that do not fill a byte of the bitmap yet
        self.tails: list[np.ndarray] = []
        self._level()

    def _level(self) -> None:
        self.chunks.append(bytearray())
        self.bitmaps.append(bytearray())
        self.tails.append(np.empty(0, bool))

    def add(self, ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> None:
        """``sizes`` has the number of ids of each document."""
        self.doc_ids.append(np.array([d or 0 for d in doc_ids], "<i8"))
        self.nulls.append(np.array([d is None for d in doc_ids], np.uint8))
        self.sizes.append(np.asarray(sizes, np.int64))
        self.docs += len(doc_ids)
        self.n_ids += len(ids)
        rest, level = ids.astype(np.uint32, copy=False), 0
        while len(rest):
            if level == len(self.chunks):
                self._level()
            self.chunks[level] += (rest & 0xFF).astype(np.uint8).tobytes()
            rest = rest >> np.uint32(8)
            more = rest > 0
            bits = np.concatenate((self.tails[level], more))
            whole = len(bits) // 8 * 8
            self.bitmaps[level] += np.packbits(bits[:whole], bitorder="little").tobytes()
            self.tails[level] = bits[whole:]
            rest, level = rest[more], level + 1

    def write(self, out) -> int:
        """Write the file, level by level; its bytes."""
        n = 0

        def put(data) -> None:
            nonlocal n
            out.write(data)
            n += len(data)

        def joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
            return np.concatenate([*parts, np.empty(0, kind)]).astype(kind, copy=False)

        put(MAGIC + struct.pack("<HHQQ", VERSION, len(self.chunks), self.docs, self.n_ids))
        put(joined(self.doc_ids, "<i8").tobytes())
        put(joined(self.nulls, "u1").tobytes())
        put(np.concatenate(([0], np.cumsum(joined(self.sizes, "<i8")))).astype("<u8").tobytes())
        for level, chunks in enumerate(self.chunks):
            put(struct.pack("<Q", len(chunks)))
            put(bytes(chunks))
            if level == len(self.chunks) - 1:
                break
            bitmap = np.frombuffer(bytes(self.bitmaps[level]) + np.packbits(self.tails[level], bitorder="little").tobytes(), np.uint8)
            blocks = -(-len(chunks) // BLOCK)
            ones = np.zeros(blocks * (BLOCK // 8), np.uint8)
            ones[: len(bitmap)] = _POPCOUNT[bitmap]
            ones = ones.reshape(blocks, BLOCK // 8).sum(axis=1, dtype=np.uint64)
            put(bitmap.tobytes())
            put((np.cumsum(ones) - ones).astype("<u8").tobytes())
        return n


def encode(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """The file for the given documents, as bytes."""
    held, out = Encoder(), io.BytesIO()
    held.add(ids, doc_ids, sizes)
    held.write(out)
    return out.getvalue()


class Reader:
    """Random access to one file's ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        version, self.n_levels, docs, self.n_ids = struct.unpack_from("<HHQQ", data, 4)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        at = 24
        ids = np.frombuffer(data, "<i8", docs, at)
        none = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, none, strict=True)]
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        at += 9 * docs + 8 * (docs + 1)
        self.levels: list[tuple] = []
        for level in range(self.n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            if level == self.n_levels - 1:
                self.levels.append((chunks, None, None))
                break
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            rank = np.frombuffer(data, "<u8", -(-n // BLOCK), at)
            at += 8 * len(rank)
            self.levels.append((chunks, bitmap, rank))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i`` of the level's bitmap."""
        _, bitmap, rank = self.levels[level]
        block = i // BLOCK
        if block == len(rank):
            if not block:
                return 0
            block -= 1
        first, whole = block * (BLOCK // 8), i // 8
        n = int(rank[block]) + int(_POPCOUNT[bitmap[first:whole]].sum(dtype=np.int64))
        if i % 8:
            n += bin(int(bitmap[whole]) & ((1 << (i % 8)) - 1)).count("1")
        return n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if bitmap is None or not (bitmap[i // 8] >> (i % 8)) & 1:
                break
            i = self._rank(level, i)
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids of [start, stop), from that range's own chunks at each level."""
        out = np.zeros(stop - start, np.uint32)
        at, here = start, np.arange(stop - start)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            n = len(here)
            out[here] |= chunks[at : at + n].astype(np.uint32) << np.uint32(8 * level)
            if bitmap is None or not n:
                break
            first = at // 8
            bits = np.unpackbits(bitmap[first : (at + n + 7) // 8], bitorder="little")[at - 8 * first :][:n]
            here = here[bits.astype(bool)]
            at = self._rank(level, at)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END_ID, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` in ascending ``key`` order to files below ``folder``; the manifest.

    Null keys come first, a null text is empty, equal keys are ordered by text.  ``folder`` is a
    URI that pyarrow's filesystems reach and that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = wordtok.for_path(tokenizer), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, at = Encoder(), 0

        def close() -> pa.RecordBatch:
            nonlocal held, at
            path = f"{root}/{part:06d}-{at:012d}-{uuid.uuid4().hex}.dact"
            with store.open_output_stream(path) as f:
                size = held.write(f)
            row = [[part], [at], [held.n_ids], [held.docs], [size], [path]]
            held, at = Encoder(), at + held.n_ids
            return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for v in row], MANIFEST.names)

        for batch in common.slices(batches, "text", wordtok.TEXT_BYTES):
            ids, sizes = tok.encode(common.as_bytes(batch.column("text")), end)
            held.add(ids, batch.column("doc_id").to_pylist(), sizes)
            if held.n_ids >= file_ids:
                yield close()
        if held.docs:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    # rows alike in key and text may go to several ranges: which of them comes first shows nowhere
    spread = rows.withColumn("_spread", F.monotonically_increasing_id() % 8191)
    ordered = spread.repartitionByRange("doc_id", tie, "_spread").sortWithinPartitions("doc_id", tie, "_spread", "text")
    return common.materialize(ordered.mapInArrow(run, MANIFEST), "dac-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens
    and the crc32 of its ids as little-endian unsigned 32-bit integers."""
    offsets = common.partition_offsets(manifest, "part_id", "n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, local, path in zip(*(batch.column(c).to_pylist() for c in ("part_id", "local_start", "path")), strict=True):
                with store.open_input_stream(path) as f:
                    file = Reader(f.read())
                begin = offsets[part] + local
                crc = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(len(file.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(begin + file.starts[:-1]), pa.array(np.diff(file.starts)), pa.array(crc, pa.int64())],
                    DOCS.names,
                )

    # a row is a file of some MB: deal the rows out evenly
    return manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)).mapInArrow(run, DOCS)


def round_trip(docs: DataFrame, tokenizer: str, end: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to the shared folder and describe each document from the files."""
    folder = common.scratch(docs.sparkSession, "dac")
    return read(write(docs, tokenizer, folder, end, key, text), folder)
