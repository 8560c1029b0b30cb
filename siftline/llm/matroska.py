"""Matroska media columns: a writer, and a parser that gives packet tables.

The parser reads variable-length EBML element ids and sizes, known or unknown sizes of segment
and clusters, simple blocks and block groups, all four kinds of lacing (none, Xiph, fixed size,
EBML) and the cue index, and gives each packet's track, timestamp and byte range.

Defined results: null media has no packets; damaged media give one row with the reason in
``error`` and nothing else; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common

# Fixed values of the Matroska and EBML specifications: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
ATTACHMENTS, CHAPTERS, TAGS = 0x1941A469, 0x1043A770, 0x1254C367
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEGMENT_LEVEL = frozenset((SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, ATTACHMENTS, CHAPTERS, TAGS))
LACING = ("none", "xiph", "fixed", "ebml")

#: The stored sample format: unsigned 8-bit mono at 8 kHz, in frames of 576 samples (72 ms).
RATE, FRAME, SCALE = 8000, 576, 1_000_000
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 50


# -- writing -----------------------------------------------------------------------------


def number(value: int, length: int = 0) -> bytes:
    """A size or lace number: the leading one bit tells the length."""
    while not length or value >= (1 << (7 * length)) - 1:
        length += 1
    return (value | 1 << (7 * length)).to_bytes(length, "big")


def element(kind: int, payload: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + number(len(payload)) + payload


def _uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: str = "none", flags: int = 0x80) -> bytes:
    """A (simple) block's payload."""
    head = number(track) + struct.pack(">hB", relative, flags | LACING.index(lacing) * 2 if lacing in ("none", "xiph") else flags | {"fixed": 4, "ebml": 6}[lacing])
    sizes = [len(f) for f in frames]
    if lacing == "none":
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml" and len(sizes) > 1:
        head += number(sizes[0])
        for before, n in zip(sizes[:-2], sizes[1:-1], strict=True):
            d, length = n - before, 1
            while not -((1 << (7 * length - 1)) - 1) <= d <= (1 << (7 * length - 1)) - 1:
                length += 1
            head += number(d + (1 << (7 * length - 1)) - 1, length)
    elif lacing == "fixed" and len(set(sizes)) != 1:
        raise ValueError("fixed-size lacing needs frames of one size")
    return head + b"".join(frames)


def mux(samples: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    """Unsigned 8-bit mono samples as a Matroska file, one packet for each ``frame`` samples."""
    step = frame * 1_000_000_000 // (rate * SCALE)
    head = element(
        EBML,
        _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
    )
    n = -(-len(samples) // frame)
    info = element(INFO, _uint(TIMESTAMP_SCALE, SCALE) + element(DURATION, struct.pack(">d", float(n * step))) + element(MUXING_APP, b"siftline") + element(WRITING_APP, b"siftline"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(rate))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, step * SCALE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    per = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, n, per):
        begin = first * step
        blocks = [_uint(TIMESTAMP, begin)]
        for i in range(first, min(first + per, n), FRAMES_PER_BLOCK):
            frames = [samples[k * frame : (k + 1) * frame] for k in range(i, min(i + FRAMES_PER_BLOCK, first + per, n))]
            lacing = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == frame else "ebml"
            blocks.append(element(SIMPLE_BLOCK, block(1, i * step - begin, frames, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, begin) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# -- parsing -----------------------------------------------------------------------------


@dataclass
class Media:
    scale: int = SCALE
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    #: (track, timestamp ns, offset, size, keyframe, lacing, cluster)
    packets: list[tuple] = field(default_factory=list)


def _vint(data: bytes, at: int, end: int, keep: bool) -> tuple[int, int, bool]:
    """The number at ``at``, where it ends, and whether all its value bits are set."""
    if at >= end or not data[at]:
        raise ValueError(f"no number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise ValueError(f"the number at byte {at} is cut off")
    raw = int.from_bytes(data[at : at + length], "big")
    value = raw & ((1 << (7 * length)) - 1)
    return raw if keep else value, at + length, value == (1 << (7 * length)) - 1


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, payload start, payload end; -1 for an unknown size)."""
    while at < end:
        kind, body, _ = _vint(data, at, end, True)
        size, body, unknown = _vint(data, body, end, False)
        if unknown:
            yield kind, at, body, -1
            return
        if body + size > end:
            raise ValueError(f"the element at byte {at} is cut off")
        yield kind, at, body, body + size
        at = body + size


def _int(data: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(data[lo:hi], "big")


def _float(data: bytes, lo: int, hi: int) -> float:
    return {0: 0.0, 4: lambda: struct.unpack(">f", data[lo:hi])[0], 8: lambda: struct.unpack(">d", data[lo:hi])[0]}[hi - lo]() if hi > lo else 0.0


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the frames' byte ranges of a block."""
    track, at, _ = _vint(data, at, end, False)
    if at + 3 > end:
        raise ValueError("a block is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = (flags >> 1) & 3
    if not kind:
        return track, relative, flags, [(at, end - at)]
    if at >= end:
        raise ValueError("a laced block is cut off")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError("lace sizes are cut off")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif kind == 3 and n > 1:
        size, at, _ = _vint(data, at, end, False)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            d, at, _ = _vint(data, at, end, False)
            size += d - ((1 << (7 * (at - start) - 1)) - 1)
            sizes.append(size)
    elif kind == 2:
        if (end - at) % n:
            raise ValueError("a fixed-size lace does not divide evenly")
        sizes = [(end - at) // n] * (n - 1)
    last = end - at - sum(sizes)
    if last < 0 or any(s < 0 for s in sizes):
        raise ValueError("lace sizes exceed the block")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return track, relative, flags, out


def _cluster(data: bytes, at: int, end: int, media: Media, no: int) -> int:
    """Packets of a cluster; where it ends.  ``end`` is the segment's for an unknown size."""
    begin = 0

    def add(lo: int, hi: int, key: bool | None, duration: int | None) -> None:
        track, relative, flags, frames = _frames(data, lo, hi)
        ns = (begin + relative) * media.scale
        step = media.tracks.get(track, {}).get("default_duration") or (duration * media.scale // len(frames) if duration else 0)
        lacing = LACING[{0: 0, 1: 1, 2: 2, 3: 3}[(flags >> 1) & 3]]
        for k, (offset, size) in enumerate(frames):
            media.packets.append((track, ns + k * step, offset, size, bool(flags & 0x80) if key is None else key, lacing, no))

    while at < end:
        kind, body, _ = _vint(data, at, end, True)
        if kind in SEGMENT_LEVEL:
            break
        size, body, unknown = _vint(data, body, end, False)
        if unknown or body + size > end:
            raise ValueError(f"the element at byte {at} is cut off")
        if kind == TIMESTAMP:
            begin = _int(data, body, body + size)
        elif kind == SIMPLE_BLOCK:
            add(body, body + size, None, None)
        elif kind == BLOCK_GROUP:
            inner = {k: (lo, hi) for k, _, lo, hi in _elements(data, body, body + size)}
            if BLOCK in inner:
                duration = _int(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
                add(*inner[BLOCK], REFERENCE_BLOCK not in inner, duration)
        at = body + size
    return at


def parse(data: bytes) -> Media:
    """Everything that the packet table needs; ValueError if the file is damaged."""
    media = Media()
    top = list(_elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("not an EBML file")
    segment = next((x for x in top if x[0] == SEGMENT), None)
    if segment is None:
        raise ValueError("no segment")
    at, end = segment[2], segment[3] if segment[3] >= 0 else len(data)
    origin = at
    while at < end:
        kind, body, _ = _vint(data, at, end, True)
        size, body, unknown = _vint(data, body, end, False)
        stop = end if unknown else body + size
        if stop > end:
            raise ValueError(f"the element at byte {at} is cut off")
        if kind == INFO:
            for k, _, lo, hi in _elements(data, body, stop):
                if k == TIMESTAMP_SCALE:
                    media.scale = _int(data, lo, hi)
                elif k == DURATION:
                    media.duration = _float(data, lo, hi)
        elif kind == TRACKS:
            for k, _, lo, hi in _elements(data, body, stop):
                if k == TRACK_ENTRY:
                    got = {x: (a, b) for x, _, a, b in _elements(data, lo, hi)}
                    audio = {x: (a, b) for x, _, a, b in _elements(data, *got[AUDIO])} if AUDIO in got else {}
                    media.tracks[_int(data, *got[TRACK_NUMBER])] = {
                        "codec": data[slice(*got[CODEC_ID])].decode() if CODEC_ID in got else "",
                        "type": _int(data, *got[TRACK_TYPE]) if TRACK_TYPE in got else 0,
                        "default_duration": _int(data, *got[DEFAULT_DURATION]) if DEFAULT_DURATION in got else None,
                        "rate": _float(data, *audio[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in audio else None,
                    }
        elif kind == CLUSTER:
            media.clusters.append(at - origin)
            stop = _cluster(data, body, stop, media, len(media.clusters) - 1)
        elif kind == CUES:
            for k, _, lo, hi in _elements(data, body, stop):
                if k == CUE_POINT:
                    got = {x: (a, b) for x, _, a, b in _elements(data, lo, hi)}
                    where = {x: (a, b) for x, _, a, b in _elements(data, *got[CUE_TRACK_POSITIONS])}
                    media.cues.append((_int(data, *got[CUE_TIME]), _int(data, *where[CUE_TRACK]), _int(data, *where[CUE_CLUSTER_POSITION])))
        at = stop
    return media


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's packets in turn, cut out by their byte ranges."""
    return b"".join(data[p[2] : p[2] + p[3]] for p in media.packets if p[0] == track)


def feature(samples: bytes, media: Media) -> str:
    """What describes the sound and its container in one line."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    last = media.packets[-1][1] // media.scale if media.packets else 0
    placed = sum(c[2] in media.clusters for c in media.cues)
    track = media.tracks.get(1, {})
    mean, spread = (float(x.mean()), float(x.std())) if len(x) else (0.0, 0.0)
    return (
        f"codec={track.get('codec', '')};rate={track.get('rate') or 0:.0f};packets={len(media.packets)};clusters={len(media.clusters)};"
        f"cues={placed}/{len(media.cues)};last_ms={last};duration_ms={media.duration or 0:.0f};mean={mean:.4f};std={spread:.4f}"
    )


# -- operators ---------------------------------------------------------------------------

PACKETS = T.StructType(
    [
        T.StructField("key", T.LongType()),
        *(T.StructField(n, T.LongType()) for n in ("track", "timestamp_ns", "offset", "size")),
        T.StructField("keyframe", T.BooleanType()),
        T.StructField("lacing", T.StringType()),
        T.StructField("cluster", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row for each packet of each Matroska file in column ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("media")
        for batch in common.slices(batches, "media"):
            rows: list[tuple] = []
            for k, data in zip(batch.column("key").to_pylist(), common.as_bytes(batch.column("media")), strict=True):
                if data is None:
                    continue
                try:
                    rows += [(k, *p, None) for p in parse(data).packets]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((k, *[None] * 7, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_pylist([dict(zip(PACKETS.names, r, strict=True)) for r in rows], schema=_arrow(PACKETS))

    return df.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media")).mapInArrow(run, PACKETS)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema])


def padded(text: bytes | None, unit: int = FRAME) -> bytes:
    """The text's bytes with 255s up to a positive multiple of ``unit``."""
    text = text or b""
    n = max(unit, -(-len(text) // unit) * unit)
    return text + b"\xff" * (n - len(text))


STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as the samples of a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("media")
        for batch in common.slices(batches, "text"):
            texts = common.as_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], STORED.names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, STORED)


def describe(stored: DataFrame) -> DataFrame:
    """Digests and features of the files in ``stored``, from their parsed packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("media")
        for batch in common.slices(batches, "media"):
            rows = []
            for doc, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), common.as_bytes(batch.column("media")), strict=True):
                found = parse(data)
                samples = payload(data, found)
                rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples, found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _arrow(DIGEST), strict=True)], DIGEST.names)

    return stored.mapInArrow(run, DIGEST)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a media column in the shared folder and describe what is read back."""
    return describe(common.materialize(store_texts(docs, key, text), "media"))
