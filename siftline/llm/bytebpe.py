"""Byte-level BPE: ids and offsets of texts, and texts of ids.

A vocabulary file of ranks (one base64 token and its rank a line) becomes a model of the
tokenizers library.  Every byte is written as one printable character, so a token is a text; a
pair of tokens merges if their bytes together are a token, at that token's rank, which is how
ranks are applied by the library that the file is for.  The pattern's matches are merged one by
one, and a match that is itself a token is taken whole.

Texts are cut before a space that follows anything but white space.  There a match of the pattern
ends always, whatever stands around, so the ids of a text are those of its pieces in turn; each
distinct piece goes through the library once while a worker remembers it.  New pieces go there many in
one text, since between them stands what ends a match, and are told apart by their bytes.  What a
worker remembers are numbers in arrays; when there is no more room, the pieces that came most stay.

Decoding reverses the byte table: the characters of an id's token are its bytes, and the bytes of
all ids in turn are the text.  A character may be split between ids; ``decode_text`` holds the
bytes of one that is not whole yet until the next id completes it.  ``encode`` gives each id the
code points that its bytes are of; ids within one character all have that character's.

Defined results: a null text is empty and has no ids; strings of special tokens are ordinary text;
what is no UTF-8 is read as U+FFFD; an id that the vocabulary lacks is an error; repeated rows give
repeated rows; an empty table stays empty; columns of any other name are ignored or, in the general
forms, carried along unless a new column has their name; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common

#: Text bytes that a task turns into ids at once; pieces and bytes of pieces that a worker remembers.
TEXT_BYTES, MAX_PIECES, MAX_BYTES = 2 << 20, 400_000, 16 << 20
#: A longer piece is not remembered.
PIECE_BYTES = 256
#: New pieces that go through the library as one text.
TOGETHER = 1000
_CUT = re.compile(r"(?<=\S)(?= )")
_LOOSE = re.compile(r"\s |\0")


def cut(text: str) -> list[str]:
    """``text`` cut before each space that follows anything but white space."""
    if _LOOSE.search(text):
        return _CUT.split(text)
    # the same by plain searches, where every space follows something else or begins the text
    return text.replace(" ", "\0 ").removeprefix("\0").split("\0") if text else []


class _Places(dict):
    """piece -> place; an unknown piece gets the next place and waits in ``pending``."""

    def __init__(self):
        super().__init__()
        self.next = 0
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.next
        self.next += 1
        self.pending.append(piece)
        return n


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else 256 and its turn."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    """A vocabulary of ranks in both directions."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        letters = byte_letters()
        ranks = sorted(read_ranks(path).items(), key=lambda x: x[1])
        known = {token for token, _ in ranks}
        name = lambda token: "".join(letters[b] for b in token)
        pairs = [(name(t[:i]), name(t[i:])) for t, _ in ranks for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
        self.tokenizer = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks}, merges=pairs, ignore_merges=True))
        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the reverse byte table, and by it the bytes of every id
        values = {c: b for b, c in enumerate(letters)}
        self.token_bytes = {i: bytes(values[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        # the same by place, and ids as decimal text, for many ids at once
        every = range(max(self.token_bytes, default=-1) + 1)
        self.bytes_of = pa.array([self.token_bytes.get(i) for i in every], pa.large_binary())
        self.decimal_of = pa.array([f"{i}," for i in every], pa.large_binary())
        self.n_bytes = np.array([len(self.token_bytes.get(i, b"")) for i in every], np.int64)
        self._forget()
        self._clear()

    def _forget(self) -> None:
        self.known: dict[str, tuple[tuple[int, ...], tuple[tuple[int, int], ...]]] = {}
        self.held = 0

    def _clear(self) -> None:
        self.places = _Places()
        self.chars = 0
        #: ids of all places in turn, where each place's begin and how many they are, how often it came
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lens, self.uses = (np.zeros(1 << 14, kind) for kind in (np.int64, np.int32, np.int64))

    def _room(self, places: int, ids: int) -> None:
        """Grow the arrays to so many places and ids."""
        while len(self.flat) < ids:
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while len(self.starts) < places:
            self.starts, self.lens, self.uses = (np.concatenate((a, np.zeros_like(a))) for a in (self.starts, self.lens, self.uses))

    def _thin(self) -> None:
        """Keep the pieces that came most, to a third of the bounds, and forget the others."""
        pieces, at = list(self.places), np.fromiter(self.places.values(), np.int64, len(self.places))
        order = np.argsort(-self.uses[at], kind="stable")
        order = order[self.uses[at[order]] > 1][: MAX_PIECES // 3]
        order = order[np.cumsum(np.fromiter((len(pieces[i]) for i in order.tolist()), np.int64, len(order))) <= MAX_BYTES // 3]
        at = at[order]
        flat, lens, uses = self._gather(at), self.lens[at], self.uses[at] // 2
        self._clear()
        for i in order.tolist():
            self.places[pieces[i]]
            self.chars += len(pieces[i])
        self.places.pending.clear()
        self._room(len(order), len(flat))
        self.flat[: len(flat)], self.used = flat, len(flat)
        self.lens[: len(order)], self.uses[: len(order)], self.starts[: len(order)] = lens, uses, np.cumsum(lens) - lens

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of places in turn."""
        lens = self.lens[at].astype(np.int64)
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(int(lens.sum()))]

    def _encode_new(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of pieces, which are put together where a cut stands between."""
        sizes = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        groups: list[list[str]] = []
        joins = False
        for p in pieces:
            if joins and p[0] == " " and len(groups[-1]) < TOGETHER:
                groups[-1].append(p)
            else:
                groups.append([p])
            joins = not p[-1].isspace() and len(p) <= PIECE_BYTES
        found = self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        ends = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(ends, np.cumsum(sizes)) + 1
        if not np.array_equal(ends[last - 1], np.cumsum(sizes)):
            raise ValueError("a token crosses a cut: the pattern is not of the expected kind")
        return ids, np.diff(last, prepend=0)

    def ids(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's end."""
        if self.places.next > MAX_PIECES or self.chars > MAX_BYTES:
            self._thin()
        places, pieces, ends = self.places, [], []
        for t in texts:
            pieces += cut(t)
            ends.append(len(pieces))
        at = np.fromiter(map(places.__getitem__, pieces), np.int64, len(pieces))
        used = self.used
        if new := places.pending:
            first = places.next - len(new)
            # long pieces come last, so that they can be forgotten
            order = sorted(range(len(new)), key=lambda i: len(new[i]) > PIECE_BYTES)
            long = [p for p in new if len(p) > PIECE_BYTES]
            flat, lens = self._encode_new([new[i] for i in order])
            self._room(places.next, self.used + len(flat))
            self.flat[self.used : self.used + len(flat)] = flat
            where = first + np.array(order)
            self.lens[where], self.starts[where] = lens, self.used + np.cumsum(lens) - lens
            used += int(lens[: len(new) - len(long)].sum())
            self.chars += sum(map(len, new)) - sum(map(len, long))
            new.clear()
            for p in long:
                del places[p]
        found = self._gather(at)
        self.used = used
        self.uses[: places.next] += np.bincount(at, minlength=places.next)
        sums = np.concatenate(([0], np.cumsum(self.lens[at], dtype=np.int64)))
        if len(self.flat) > 64 * MAX_PIECES:
            self.flat = self.flat[: max(used, 1)].copy()
        return found, sums[np.array(ends, np.int64)]

    def _learn(self, pieces: Sequence[str]) -> dict:
        """Ids and offsets of pieces that are not known; the short ones are remembered."""
        found = {}
        for piece, e in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            found[piece] = tuple(e.ids), tuple(e.offsets)
            if len(piece) <= PIECE_BYTES:
                self.known[piece] = found[piece]
                # an id and its offsets take some 200 bytes
                self.held += len(piece) + 200 * len(e.ids)
        return found

    def encode(self, texts: Iterable[str], offsets: bool = False) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        """Ids of each text and, on demand, the range of code points that each id is of."""
        if not offsets:
            texts = list(texts)
            found, ends = self.ids(texts)
            yield from ((x.tolist(), []) for x in np.split(found, ends)[: len(texts)])
            return
        if len(self.known) > MAX_PIECES or self.held > 8 * MAX_BYTES:
            self._forget()
        pieces_of = [cut(t) for t in texts]
        known = self.known
        fresh = self._learn(sorted({p for pieces in pieces_of for p in pieces if p not in known}))
        for pieces in pieces_of:
            ids: list[int] = []
            places: list[tuple[int, int]] = []
            at = 0
            for p in pieces:
                got = known.get(p) or fresh[p]
                ids += got[0]
                places += [(at + a, at + b) for a, b in got[1]]
                at += len(p)
            yield ids, places

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each id completes: nothing while a character is not whole."""
        whole = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield whole.decode(self.token_bytes[i])
        if left := whole.decode(b"", True):
            yield left


def pattern() -> str:
    """The public vocabularies' own pattern."""
    import public_tokenizers

    return public_tokenizers.PATTERN


_models: dict[tuple[str, str], ByteBpe] = {}
common.cached("bytebpe", _models.clear)


def for_vocabulary(path: str, pattern: str) -> ByteBpe:
    """This worker's model."""
    common.enter("bytebpe")
    if (path, pattern) not in _models:
        _models[path, pattern] = ByteBpe(path, pattern)
    return _models[path, pattern]


def _texts(column: pa.Array) -> list[str]:
    return [str(b, "utf-8", "replace") if b else "" for b in common.as_bytes(column)]


#: What a worker is given; a column of the input of that name gives way.
_IN = "_bytebpe_in"


def _own(docs: DataFrame, new: Sequence[str], reads: str) -> list[str]:
    return [c for c in docs.columns if c not in (*new, reads, _IN)]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, and starts and ends of each id in code points, in place of the text."""
    new = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] + [T.StructField(n, T.ArrayType(T.LongType(), False)) for n in ("starts", "ends")]
    own = _own(docs, [f.name for f in new], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = for_vocabulary(vocabulary, pattern)
        for batch in common.slices(batches, _IN, TEXT_BYTES):
            found = list(bpe.encode(_texts(batch.column(_IN)), offsets=True))
            columns = [pa.array([ids for ids, _ in found], pa.list_(pa.int32())), *(pa.array([[p[i] for p in places] for _, places in found], pa.list_(pa.int64())) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *columns], [*own, *(f.name for f in new)])

    return docs.select(*own, F.col(text).cast("string").alias(_IN)).mapInArrow(run, T.StructType([*(docs.schema[c] for c in own), *new]))


def decode(coded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``coded`` with bytes (of all ids in turn) and text (bytes that are no UTF-8 as U+FFFD) in
    place of the ids; a null array is empty."""
    new = [T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())]
    own = _own(coded, [f.name for f in new], ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = for_vocabulary(vocabulary, pattern)
        for batch in batches:
            coded_rows = [x or () for x in batch.column(_IN).to_pylist()]
            raw, texts = [bpe.decode(x) for x in coded_rows], ["".join(bpe.decode_text(x)) for x in coded_rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(raw, pa.binary()), pa.array(texts, pa.string())], [*own, "bytes", "text"])

    return coded.select(*own, F.col(ids).alias(_IN)).mapInArrow(run, T.StructType([*(coded.schema[c] for c in own), *new]))


DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _digests(parts: pa.LargeBinaryArray, ends: np.ndarray, less: int = 0) -> list[str]:
    """sha256 of the parts of each text, put together, without the last ``less`` bytes of any."""
    _, offsets, data = parts.buffers()
    at = np.frombuffer(offsets, np.int64)[parts.offset :][np.concatenate(([0], ends))].tolist() if len(parts) else [0] * (len(ends) + 1)
    whole = memoryview(data or b"")
    return [hashlib.sha256(whole[a : max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:])]


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: its number of ids, their hash, and the hash of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = for_vocabulary(vocabulary, pattern)
        for batch in common.slices(batches, "text", TEXT_BYTES):
            ids, ends = bpe.ids(_texts(batch.column("text")))
            # without the comma after a text's last id
            ids_sha = _digests(pc.take(bpe.decimal_of, pa.array(ids)), ends, 1)
            text_sha = _digests(pc.take(bpe.bytes_of, pa.array(ids)), ends)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends, prepend=0)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], DIGESTS.names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, DIGESTS)
