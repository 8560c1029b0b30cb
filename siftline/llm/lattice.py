"""Language-model scores from a lattice of subwords.

The pieces of a public vocabulary are the arcs of a word's lattice; a unigram model over pieces
weights every path, and the forward recursion in log space sums all of them: the probability of
the word whatever its segmentation.  The vocabulary's own scores are merge ranks, not log
probabilities; they give the first weights, and expectation maximisation over the distinct words
of all training documents refits them.

A word that training documents have is one more arc over the whole word.  A text's next step is
such an arc, a word spelled in pieces, or the end, and all of them share one distribution: the arc
of a word seen ``c`` times weighs ``c - D``, the pieces share what the arcs gave up, ``D`` for
each distinct word and 1 besides, and the end weighs its own count and 1.  ``D`` is ``n1 / (n1 + 2
n2)``, from the words seen once and twice.  A step's probabilities sum to one, but for paths of
pieces that spell no word.  ``pieces_score`` is of the vocabulary's pieces and the end alone.

Counts of words grow with the corpus and stay distributed.  The ``HEAD`` most frequent words at
most, none longer than ``HEAD_BYTES``, go to every task and save the join; all others meet their
counts and scores there.  Where a word is looked up changes no score.

Defined results: a null text is empty and scores as its end alone; rows are scored each by its
own text, so repeats and ties do not matter; characters outside the vocabulary go by its byte
pieces; without training documents every word is unknown and pieces weigh by rank; an empty table
stays empty; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common

#: Documents with this crc32 remainder are held out.
MODULUS, HELD_OUT = 7, 2
#: Words that every task knows, and bytes of the longest of them; the rest are joined.
HEAD, HEAD_BYTES = 65_536, 64
#: Rounds of expectation maximisation, and the uses added to each piece.
ROUNDS, ADDED = 4, 0.01
#: Words of up to so many characters go through arrays, so many words at once.
LONGEST, WORDS = 40, 8192
FLUSH = 300_000
MARK = "▁"
LOG10 = math.log(10)


class Pieces:
    """The arcs: piece -> number; -1 for what only begins a piece.

    ``ranks`` orders the pieces, the most trusted first; ``bytes`` has the numbers of the 256 byte
    pieces.
    """

    def __init__(self, pieces: dict[str, int], bytes_: list[int], ranks: np.ndarray):
        self.arcs, self.bytes, self.size = dict(pieces), bytes_, len(ranks)
        self.seed = np.log(1 / (2.0 + ranks))
        self.seed -= np.log(np.exp(self.seed).sum())
        for piece in pieces:
            for k in range(1, len(piece)):
                self.arcs.setdefault(piece[:k], -1)
        # the same as a tree in arrays: edges by node and character
        nodes = {"": 0} | {k: i for i, k in enumerate(self.arcs, 1)}
        chars = {c: i for i, c in enumerate(sorted({c for k in self.arcs for c in k}), 1)}
        self.n_chars = len(chars) + 1
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = list(chars.values())
        keys = np.array([nodes[k[:-1]] * self.n_chars + chars[k[-1]] for k in self.arcs], np.int64)
        order = np.argsort(keys)
        self.edges, self.child = keys[order], np.array([nodes[k] for k in self.arcs], np.int64)[order]
        self.piece_of = np.array([-1, *self.arcs.values()], np.int64)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        used = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces, spelled, ranks = {}, [0] * 256, np.empty(len(used))
        for n, i in enumerate(used):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spelled[int(piece[3:5], 16)] = n
            else:
                pieces[piece] = n
            ranks[n] = len(used) if model.is_byte(i) else -model.get_score(i)
        return cls(pieces, spelled, ranks)

    def spelled(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character that is no piece itself."""
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))

    def lattice(self, word: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """For each position, the arcs that end there: (where it begins, piece numbers)."""
        text = MARK + word
        n, get = len(text), self.arcs.get
        into: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                k = get(text[i:j])
                if k is None:
                    break
                if k >= 0:
                    into[j].append((i, (k,)))
            if get(text[i], -1) < 0:
                into[i + 1].append((i, self.spelled(text[i])))
        return into


class Lattices:
    """The lattices of many words at once.

    An arc is (word, its end, its length, piece); arcs of one end and length are one group, so a
    recursion takes a few array steps for each group, whatever the number of words.  Characters
    that are no piece have numbers from ``pieces.size`` on.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.pieces = pieces
        self.lens = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        ends = np.cumsum(self.lens)
        word = np.repeat(np.arange(len(words)), self.lens)
        place = np.arange(len(codes)) - (ends - self.lens)[word]
        left, char = self.lens[word] - place, pieces.char[codes].astype(np.int64)
        at, node, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 1
        bare = np.ones(len(codes), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def keep(at: np.ndarray, length: int, k: np.ndarray) -> None:
            found.append((word[at], place[at] + length, np.full(len(at), length), k))

        while len(at):
            keys = node * pieces.n_chars + char[at + depth - 1]
            edge = np.minimum(np.searchsorted(pieces.edges, keys), len(pieces.edges) - 1)
            on = pieces.edges[edge] == keys
            at, node = at[on], pieces.child[edge[on]]
            k = pieces.piece_of[node]
            keep(at[k >= 0], depth, k[k >= 0])
            if depth == 1:
                bare[at[k >= 0]] = False
            more = left[at] > depth
            at, node, depth = at[more], node[more], depth + 1
        odd = np.flatnonzero(bare)
        self.odd, which = np.unique(codes[odd], return_inverse=True)
        keep(odd, 1, pieces.size + which)
        w, j, n, k = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((n, j))
        w, j, n, k = w[order], j[order], n[order], k[order]
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(j) != 0) | (np.diff(n) != 0), [True])))
        self.groups = [(int(j[a]), int(j[a] - n[a]), w[a:b], k[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(w) else []

    def _weights(self, logp: np.ndarray) -> np.ndarray:
        odd = [sum(logp[b] for b in self.pieces.spelled(chr(c))) for c in self.odd]
        return np.concatenate((logp, odd))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """(positions, words): log of what all paths from the start weigh."""
        logp = self._weights(logp)
        alpha = np.full((int(self.lens.max(initial=0)) + 1, len(self.lens)), -np.inf)
        alpha[0] = 0.0
        for j, i, w, k in self.groups:
            alpha[j, w] = np.logaddexp(alpha[j, w], alpha[i, w] + logp[k])
        return alpha

    def scores(self, logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        return self.forward(logp)[self.lens, np.arange(len(self.lens))]

    def expect(self, logp: np.ndarray, uses: np.ndarray) -> None:
        """Add the expected number of uses of each piece in one copy of every word."""
        alpha, full = self.forward(logp), self._weights(logp)
        every = np.arange(len(self.lens))
        whole = alpha[self.lens, every]
        beta = np.full_like(alpha, -np.inf)
        beta[self.lens, every] = 0.0
        found = np.zeros(len(full))
        # by falling end: what follows a position is complete before an arc into it is met
        for j, i, w, k in reversed(self.groups):
            onward = beta[j, w] + full[k]
            beta[i, w] = np.logaddexp(beta[i, w], onward)
            found += np.bincount(k, np.exp(alpha[i, w] + onward - whole[w]), len(found))
        uses += found[: len(uses)]
        for c, n in zip(self.odd.tolist(), found[len(uses) :].tolist(), strict=True):
            for b in self.pieces.spelled(chr(c)):
                uses[b] += n


def word_score(word: str, pieces: Pieces, logp: np.ndarray) -> float:
    """Natural log of one word's marginal probability, however long it is."""
    total = [0.0]
    for into in pieces.lattice(word)[1:]:
        ways = [total[i] + sum(logp[b] for b in k) for i, k in into]
        top = max(ways)
        total.append(top + math.log(sum(math.exp(x - top) for x in ways)))
    return total[-1]


def _expect_long(word: str, pieces: Pieces, logp: np.ndarray, uses: np.ndarray) -> None:
    into = pieces.lattice(word)
    alpha, n = [0.0], len(into)
    for arcs in into[1:]:
        ways = [alpha[i] + sum(logp[b] for b in k) for i, k in arcs]
        top = max(ways)
        alpha.append(top + math.log(sum(math.exp(x - top) for x in ways)))
    #: share of the paths that pass a position
    passes = [0.0] * n
    passes[-1] = 1.0
    for j in range(n - 1, 0, -1):
        for i, k in into[j]:
            share = passes[j] * math.exp(alpha[i] + sum(logp[b] for b in k) - alpha[j])
            passes[i] += share
            for b in k:
                uses[b] += share


def _parted(words: Iterable[str]) -> tuple[list[str], list[int], list[str], list[int]]:
    """Words for arrays and their places, longer ones and theirs."""
    short, long = ([], []), ([], [])
    for i, w in enumerate(words):
        to = short if len(w) <= LONGEST else long
        to[0].append(w)
        to[1].append(i)
    return *short, *long


def expect(words: list[str], pieces: Pieces, logp: np.ndarray, uses: np.ndarray) -> None:
    """Add the expected uses of each piece in one copy of every word."""
    short, _, long, _ = _parted(words)
    for lo in range(0, len(short), WORDS):
        Lattices(short[lo : lo + WORDS], pieces).expect(logp, uses)
    for w in long:
        _expect_long(w, pieces, logp, uses)


def word_scores(words: list[str], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Natural log of every word's marginal probability."""
    out = np.empty(len(words))
    short, places, long, others = _parted(words)
    for lo in range(0, len(short), WORDS):
        out[places[lo : lo + WORDS]] = Lattices(short[lo : lo + WORDS], pieces).scores(logp)
    for at, w in zip(others, long, strict=True):
        out[at] = word_score(w, pieces, logp)
    return out


def normal(uses: np.ndarray, added: float = ADDED) -> np.ndarray:
    uses = uses + added
    return np.log(uses / uses.sum())


_pieces: dict[str, Pieces] = {}
_share: dict = {}


def pieces_at(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces.load(path)
    return _pieces[path]


def _forget() -> None:
    _pieces.clear()
    _share.clear()


common.cached("lattice", _forget)


class Steps:
    """The distribution of a text's next step."""

    def __init__(self, tokens: int, ends: int, distinct: int, once: int, twice: int):
        self.discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.whole = tokens + 2
        #: weights of a word in pieces and of the end
        self.spelling, self.end = (self.discount * distinct + 1) / self.whole, (ends + 1) / self.whole

    def arc(self, c: int) -> float:
        """Weight of the arc over a word seen ``c`` times."""
        return max(0.0, c - self.discount) / self.whole


COUNTS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType())])
SCORED = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("worth", T.DoubleType()),
        T.StructField("spelled", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.BinaryType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ]
)


def word_counts(rows: DataFrame) -> DataFrame:
    """Every word of the rows' texts and its occurrences in training texts, summed in each task
    first; 0 where only held-out texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("lattice")
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], COUNTS.names)
            held.clear()
            return batch

        for batch in common.slices(batches, "text"):
            for t, training in zip(common.as_bytes(batch.column("text")), batch.column("training").to_pylist(), strict=True):
                words = t.lower().split() if t else ()
                if training:
                    held.update(words)
                else:
                    for w in words:
                        held.setdefault(w, 0)
            if len(held) > FLUSH:
                yield out()
        if held:
            yield out()

    return rows.select("text", (~F.col("held_out")).alias("training")).mapInArrow(run, COUNTS).groupBy("word").agg(F.sum("c").alias("c"))


def _decoded(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in common.as_bytes(column)]


def fit(words: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probability of each piece, from ``words``, each spelled once.

    The driver gathers one number for each piece of the vocabulary, whatever the corpus.
    """
    logp = pieces_at(vocabulary).seed
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            common.enter("lattice")
            pieces = pieces_at(vocabulary)
            found = np.zeros(pieces.size)
            for batch in batches:
                expect(_decoded(batch.column("word")), pieces, logp, found)
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(found[used])], ["piece", "uses"])

        total = np.zeros(len(logp))
        for piece, uses in words.select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect():
            total[piece] = uses
        if not total.any():
            break
        logp = normal(total)
    return logp


def scored_words(words: DataFrame, vocabulary: str, logp: np.ndarray) -> DataFrame:
    """``words`` and ``s``, the log10 of what all segmentations of ``word`` weigh."""
    schema = T.StructType([*words.schema.fields, T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("lattice")
        for batch in batches:
            s = word_scores(_decoded(batch.column("word")), pieces_at(vocabulary), logp) / LOG10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], schema.names)

    return words.mapInArrow(run, schema)


def score(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, lookup: int = HEAD) -> DataFrame:
    """Every row's base and lattice scores; see the module and ``op2_lattice``.

    ``lookup`` words at most go to every task, which does not change a score.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("held_out", common.doc_hash(F.col("doc_id"), MODULUS) == HELD_OUT)
    counts = common.materialize(word_counts(rows), "lm-counts")
    ends = rows.filter(~F.col("held_out")).count()
    powers = [1 << i for i in range(48)]
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), *(F.count_if(F.col("c") >= p) for p in powers)).first()
    occurrences, once, twice, *at_least = stats
    total, distinct = occurrences + ends, at_least[0] + (ends > 0)
    steps = Steps(total, ends, at_least[0], once, twice)
    logp = fit(counts.filter("c > 0"), vocabulary, rounds)
    words = common.materialize(scored_words(counts, vocabulary, logp), "lm-words")
    common.discard(counts)
    # those from the least power of two that leaves no more than ``lookup`` words
    frequent = words.filter((F.col("c") >= next(p for p, n in zip(powers, at_least, strict=True) if n <= lookup)) & (F.octet_length("word") <= HEAD_BYTES))
    known = docs.sparkSession.sparkContext.broadcast({bytes(w): (c, s) for w, c, s in frequent.collect()})
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("lattice")
        part, at = TaskContext.get().partitionId(), 0
        if run_id not in _share:
            _share.clear()
            #: log10 of c + 1, of the word's probability, and of its spelling alone
            _share[run_id] = {w: (math.log10(c + 1), math.log10(steps.arc(c) + steps.spelling * 10.0**s), s) for w, (c, s) in known.value.items()}
        share = _share[run_id].get
        for batch in common.slices(batches, "text", common.SLICE_BYTES // 4):
            out = []
            for doc, held, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), common.as_bytes(batch.column("text")), strict=True):
                words = t.lower().split() if t else ()
                n = base = worth = spelled = 0
                rest, times = [], []
                for w, k in Counter(words).items():
                    found = share(w)
                    if found is None:
                        rest.append(w)
                        times.append(k)
                    else:
                        n += k
                        base += k * found[0]
                        worth += k * found[1]
                        spelled += k * found[2]
                out.append((part << 33 | at, doc, held, len(words) + 1, n, float(base), float(worth), float(spelled), rest, times))
                at += 1
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], SCORED.names)

    scored = common.materialize(rows.mapInArrow(run, SCORED), "lm-scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.times").alias("k"))
    arc = F.greatest(F.lit(0.0), F.col("c") - F.lit(steps.discount)) / F.lit(float(steps.whole))
    rare = words.select(
        "word",
        (F.col("c") > 0).cast("long").alias("known"),
        F.log10(F.col("c") + 1).alias("base"),
        # by the larger part, so that neither can be too small for a double
        F.greatest(F.log10(arc), F.lit(math.log10(steps.spelling)) + F.col("s")).alias("top"),
        F.log10(arc).alias("as_arc"),
        (F.lit(math.log10(steps.spelling)) + F.col("s")).alias("as_pieces"),
        F.col("s").alias("spelled"),
    )
    ten = F.lit(10.0)
    sums = F.coalesce(F.pow(ten, F.col("as_arc") - F.col("top")), F.lit(0.0)) + F.pow(ten, F.col("as_pieces") - F.col("top"))
    rare = rare.select("word", "known", "base", (F.col("top") + F.log10(sums)).alias("worth"), "spelled")
    names = ("known", "base", "worth", "spelled")
    found = pairs.join(rare, "word").groupBy("row").agg(*(F.sum(F.col("k") * F.col(c)).alias(f"rest_{c}") for c in names))
    both = {c: F.col(c) + F.coalesce(f"rest_{c}", F.lit(0)) for c in names}
    per_token = math.log10(total + distinct + 1)
    spoken = math.log10(1 - steps.end)
    return scored.drop("words", "times").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (both["known"] + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (both["base"] + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        # the end may come after any word
        (both["worth"] + F.lit(math.log10(steps.end))).alias("score"),
        (both["spelled"] + (F.col("n_tokens") - 1) * F.lit(spoken) + F.lit(math.log10(steps.end))).alias("pieces_score"),
    )
