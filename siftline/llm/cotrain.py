"""A quality classifier by co-training.

Two views of a document that share nothing: its text content (character classes, repetition,
layout, hashed words) and its page metadata (the columns source, lang and n_chars).  Each view has a logistic classifier.  In
each round both are fitted to their labelled rows and calibrated on labelled rows that neither
has seen, and each hands its most confident predictions on unlabelled rows to the other as labels.
Confidence is the calibrated probability, and a view that tells no more of those rows than their
mean does hands over nothing, however sure its classifier is.  At the end a logistic model combines the calibrated views, and every
document is scored.

At most ``LABELLED`` labelled documents, chosen by hash, are gathered, one row for each key.  The
unlabelled ones, all of them, stay distributed: both views of every row are written once.  A round
makes two passes over them.  The first counts all rows by confidence and sets the cuts, the second
gathers of the rows that were handed over ``HANDED`` for each view (expected; chosen by hash), and
the views are fitted to those and the labelled ones.  A task replays from the rounds' classifiers
and cuts what a row was handed, so no state of rows is kept.  A cut is a bin of the logit; of the
rows in the last bin a hash takes the share that is still wanted.  Scoring covers all rows in one
pass without a shuffle.

Defined results: a null text is empty; repeated rows get equal scores; where labels of a
document differ the majority holds and an even split counts as bad; unlabelled or null qualities
are ignored; without labels of both kinds every score is 0.5 and every row is kept; an empty
table stays empty; missing metadata columns count as null, other columns are carried through
(``text_score``, ``meta_score``, ``score`` and ``kept`` replace columns of those names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common

#: Bounds of the labelled rows, and of a view's pseudo-labelled ones, that are fitted on.
LABELLED, HANDED = 4000, 4000
#: Share of the labelled sample kept for calibration, in tenths.
CALIBRATION = 3
ROUNDS, GROWTH = 5, 0.05
#: A prediction whose calibrated probability is at least this may be handed over.
SURE = 0.95
#: Likelihood ratio from which a view hands over anything: 1 in 100 for a view that tells nothing.
TELLS = 6.63
#: Bins of the logit from ``SURE`` up, by which the most confident rows are chosen.
BINS, LEAST, MOST = 1024, float(np.log(SURE / (1 - SURE))), 30.0
WORD_BINS, SOURCE_BINS, LANG_BINS = 64, 32, 8
RIDGE = 1.0
THRESHOLD = 0.5
#: Words that a worker keeps the bins of, and bytes of the longest of them.
MAX_WORDS, WORD_BYTES = 100_000, 64

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>{}[]\\^~=_@+/"
_STOP = b".!?,;:'\"()-"
_N_TEXT = 13 + WORD_BINS
_N_META = 2 + SOURCE_BINS + LANG_BINS


class _Bins(dict):
    def __missing__(self, word: bytes) -> int:
        n = xxhash.xxh32_intdigest(word) % WORD_BINS
        if len(word) <= WORD_BYTES:
            self[word] = n
        return n


_bins = _Bins()
common.cached("quality", _bins.clear)


def text_view(text: bytes | None) -> np.ndarray:
    """Character classes, repetition, layout and hashed words of the content."""
    text = text or b""
    n = max(1, len(text))
    out = np.zeros(_N_TEXT, np.float32)
    words = text.lower().split()
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / n
    out[0], out[1], out[2], out[3], out[4] = share(_UPPER), share(_LOWER), share(_DIGIT), share(_SYMBOL), share(_STOP)
    out[5] = text.count(b"!") / n
    lines = text.count(b"\n") + 1
    out[11], out[12] = np.log1p(lines), text.count(b"\n\n") / lines
    if words:
        m = len(words)
        out[6] = np.log1p(m)
        out[7] = len(text) / m / 10
        # distinct words against what a text of this length has at most; neighbours alike
        out[8] = len(set(words)) / m
        out[9] = sum(map(bytes.__eq__, words, words[1:])) / m
        out[10] = words.count(b"|") / m
        out[13:] = np.sqrt(np.bincount(np.fromiter(map(_bins.__getitem__, words), np.int64, m), minlength=WORD_BINS) / m)
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Where the page is from, its stated language and its stated length."""
    out = np.zeros(_N_META, np.float32)
    out[0] = np.log1p(max(0, n_chars or 0))
    out[1] = n_chars is None
    out[2 + xxhash.xxh32_intdigest(repr(source).encode()) % SOURCE_BINS] = 1
    out[2 + SOURCE_BINS + xxhash.xxh32_intdigest(repr(lang).encode()) % LANG_BINS] = 1
    return out


def _newton(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hessian and gradient of the logistic loss, without the ridge."""
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return (z * (p * (1 - p) + 1e-9)[:, None]).T @ z, z.T @ (p - y)


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]).astype(np.float64)

    def step(self, hessian: np.ndarray, gradient: np.ndarray, ridge: float = RIDGE) -> float:
        """One Newton step; how far a weight would have gone at most."""
        pull = np.full(len(self.w), ridge)
        pull[-1] = 1e-6
        move = np.linalg.solve(hessian + np.diag(pull), gradient + pull * self.w)
        self.w = self.w - move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
        return float(np.abs(move).max())

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self.standardised(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            if self.step(*_newton(z, y, self.w), ridge) < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


class Calibrated:
    """A view's classifier, and what its logits are worth on rows that it has not seen."""

    def __init__(self, view: Logistic, x: np.ndarray, y: np.ndarray):
        self.view, self.calibration = view, Logistic().fit(view.logit(x)[:, None], y)
        p, prior = np.clip(1 / (1 + np.exp(-self.logit(x))), 1e-12, 1 - 1e-12), np.clip(y.mean(), 1e-12, 1 - 1e-12)
        told = np.log(np.where(y == 1, p, 1 - p)).sum() - np.log(np.where(y == 1, prior, 1 - prior)).sum()
        #: whether it tells more of those rows than their mean does, by the likelihood ratio
        self.tells = 2 * told >= TELLS

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.logit(self.view.logit(x)[:, None])


class CoTrained:
    """Both calibrated views and the model that combines them."""

    def __init__(self, views: list[Calibrated], combined: Logistic):
        self.calibrated, self.combined = views, combined

    @property
    def views(self) -> list[Logistic]:
        return [v.view for v in self.calibrated]

    def _calibrated(self, xs: list[np.ndarray]) -> np.ndarray:
        return np.stack([v.logit(x) for v, x in zip(self.calibrated, xs, strict=True)], axis=1)

    def __call__(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = self._calibrated(xs)
        each = 1 / (1 + np.exp(-z))
        return each[:, 0], each[:, 1], self.combined(z)


class Round:
    """What one round hands over: its calibrated views, and for each giver and kind a cut, (bin, share
    of that bin's rows)."""

    def __init__(self, views: list[Calibrated]):
        self.views = views
        self.cuts: list[list[tuple[int, float]]] = [[(BINS, 0.0)] * 2 for _ in views]


def _bin(sure: np.ndarray) -> np.ndarray:
    """Bin of a logit; -1 below ``SURE``."""
    return np.where(sure < LEAST, -1, np.minimum(BINS - 1, (np.maximum(sure, LEAST) - LEAST) * (BINS / (MOST - LEAST)))).astype(np.int64)


def _handed(xs: list[np.ndarray], u: np.ndarray, rounds: list[Round]) -> list[np.ndarray]:
    """For each view, the label that its rows got from the other in these rounds; -1 without."""
    out = [np.full(len(u), -1.0) for _ in xs]
    for done in rounds:
        for giver, taker in ((0, 1), (1, 0)):
            logit = done.views[giver].logit(xs[giver])
            free = out[taker] < 0
            for kind, sure in ((1, logit), (0, -logit)):
                at, (cut, share) = _bin(sure), done.cuts[giver][kind]
                out[taker][free & ((at > cut) | ((at == cut) & (u < share)))] = kind
    return out


def confident(xs: list[np.ndarray], u: np.ndarray, rounds: list[Round], views: list[Calibrated]) -> np.ndarray:
    """Rows, then rows in each bin that are free for the taker, by giver and kind."""
    got = _handed(xs, u, rounds)
    out = [np.array([len(u)], np.float64)]
    for giver, taker in ((0, 1), (1, 0)):
        logit = views[giver].logit(xs[giver])
        for sure in (-logit, logit):
            at = _bin(sure)
            out.append(np.bincount(at[(at >= 0) & (got[taker] < 0)], minlength=BINS).astype(np.float64))
    return np.concatenate(out)


def _split(sums: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(sums, np.cumsum(sizes)[:-1])


def _sampled(xs: list[np.ndarray], u: np.ndarray, v: np.ndarray, rounds: list[Round], rates: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view, of the rows handed to it those that its rate takes, and their labels."""
    out = []
    for x, got, rate in zip(xs, _handed(xs, u, rounds), rates, strict=True):
        taken = (got >= 0) & (v < rate)
        out.append((x[taken], got[taken]))
    return out


class Pool:
    """The unlabelled rows in memory: both views and two numbers from 0 to 1 for each."""

    def __init__(self, a: np.ndarray, b: np.ndarray, u: np.ndarray | None = None, v: np.ndarray | None = None):
        rng = np.random.default_rng(0)
        self.xs, self.u, self.v = [a, b], rng.random(len(a)) if u is None else u, rng.random(len(a)) if v is None else v

    def confident(self, rounds: list[Round], views: list[Calibrated]) -> np.ndarray:
        return confident(self.xs, self.u, rounds, views)

    def sampled(self, rounds: list[Round], rates: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        return _sampled(self.xs, self.u, self.v, rounds, rates)


def _cut(found: np.ndarray, wanted: int) -> tuple[int, float]:
    """The cut above which ``wanted`` of the rows counted by bin lie, or all."""
    above = 0.0
    for at in np.nonzero(found)[0][::-1]:
        if above + found[at] >= wanted:
            return int(at), (wanted - above) / found[at]
        above += found[at]
    return -1, 0.0


def cotrain(labelled: list[np.ndarray], y: np.ndarray, calibrating: np.ndarray, pool: Pool | SpreadPool, rounds: int = ROUNDS) -> CoTrained:
    """Fit on the labelled rows that are not for ``calibrating``, with the pool's help."""
    fit = ~calibrating
    own = [x[fit] for x in labelled]
    good = float(y[fit].mean())
    held = calibrating if calibrating.any() and len(set(y[calibrating])) == 2 else fit
    done: list[Round] = []
    #: rows wanted for each view so far, which is as many as it was handed at most
    wanted = [0, 0]

    def fitted() -> list[Calibrated]:
        rates = [min(1.0, HANDED / n) if n else 0.0 for n in wanted]
        more = pool.sampled(done, rates) if any(rates) else [(x[:0], y[:0]) for x in own]
        views = [Logistic().fit(np.vstack([x, a]), np.concatenate([y[fit], b])) for x, (a, b) in zip(own, more, strict=True)]
        return [Calibrated(v, x[held], y[held]) for v, x in zip(views, labelled, strict=True)]

    for _ in range(rounds):
        now = Round(fitted())
        givers = [k for k in (0, 1) if now.views[k].tells]
        if not givers:
            break
        count, *found = _split(pool.confident(done, now.views), [1, *[BINS] * 4])
        n = int(GROWTH * count[0])
        for giver in givers:
            # the most confident of either kind, in the labelled rows' proportion
            most = [max(1, round(n * share)) for share in (1 - good, good)]
            now.cuts[giver] = [_cut(found[2 * giver + kind], most[kind]) for kind in (0, 1)]
            wanted[1 - giver] += sum(most)
        done.append(now)
    out = CoTrained(fitted(), Logistic())
    out.combined.fit(out._calibrated([x[held] for x in labelled]), y[held])
    return out


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    common.enter("quality")
    if len(_bins) > MAX_WORDS:
        _bins.clear()
    texts = common.as_bytes(batch.column("text"))
    meta = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)
    return [np.stack([text_view(t) for t in texts]), np.stack([meta_view(*m) for m in meta])]


def _hash(key: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key, F.lit(-1)), F.lit(salt)), F.lit(1 << 30))


def _inputs(docs: DataFrame, own: list[str], text: str) -> DataFrame:
    """Carried columns under numbered names, so that none clashes with a view's."""

    def meta(name: str, kind: str) -> Column:
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(own)), F.col(text).cast("string").alias("text"), meta("source", "string"), meta("lang", "string"), meta("n_chars", "long"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> CoTrained | None:
    """A model from the labelled and unlabelled samples; None without labels of both kinds."""
    given = labels.filter(F.col(quality).isNotNull() & F.col(key).isNotNull())
    votes = given.groupBy(F.col(key).cast("long").alias("doc_id")).agg((F.avg(F.col(quality).cast("double")) > 0.5).cast("double").alias("good"))
    rows = _inputs(docs.withColumn("doc_id", F.col(key).cast("long")), ["doc_id"], text).withColumnRenamed("_0", "doc_id")
    # at most LABELLED rows, whatever the number of labels: the broadcast is bounded
    picked = votes.orderBy(_hash(F.col("doc_id"), "labelled"), "doc_id").limit(LABELLED)
    names = ["doc_id", "good", "calibrating", "u", "v"]
    schema = "doc_id long, good double, calibrating boolean, u double, v double, a binary, b binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            a, b = _views(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())], [*names, "a", "b"])

    marked = rows.join(F.broadcast(picked), "doc_id", "left").withColumn("calibrating", _hash(F.col("doc_id"), "fold") % 10 < CALIBRATION)
    marked = marked.withColumns({c: _hash(F.col("doc_id"), salt) / float(1 << 30) for c, salt in (("u", "pool"), ("v", "sample"))})
    views = common.materialize(marked.select(*rows.columns, "good", "calibrating", "u", "v").mapInArrow(run, schema), "quality-views")
    # a key may have any number of rows: one of them stands for it
    labelled = views.filter("good IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("a", "b", "good", "calibrating")).alias("r"))
    sure = [x.r for x in labelled.orderBy("doc_id").collect()]
    model = None
    if len({r.good for r in sure if not r.calibrating}) == 2:
        known = [_stacked([getattr(r, c) for r in sure], n) for c, n in (("a", _N_TEXT), ("b", _N_META))]
        model = cotrain(known, np.array([r.good for r in sure]), np.array([r.calibrating for r in sure]), SpreadPool(views.filter("good IS NULL").select("u", "v", "a", "b")))
    common.discard(views)
    return model


def _stacked(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, width)


class SpreadPool:
    """The unlabelled rows as a frame (u, v, a, b)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.few = math.isqrt(rows.sparkSession.sparkContext.defaultParallelism) + 1

    def confident(self, rounds: list[Round], views: list[Calibrated]) -> np.ndarray:
        """One row of sums for each task, added up in as many tasks as the root of the cores, and
        the rest on the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from summed(confident(_unpacked(b), b.column("u").to_numpy(), rounds, views) for b in batches if b.num_rows)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from summed(np.frombuffer(raw) for b in batches for raw in common.as_bytes(b.column("sums")))

        def summed(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            common.enter("quality")
            out = None
            for x in parts:
                out = x if out is None else out + x
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        sums = np.zeros(1 + 4 * BINS)
        # all are counts: the order in which they are added does not show
        for r in self.rows.mapInArrow(run, "sums binary").repartition(self.few).mapInArrow(add, "sums binary").collect():
            sums = sums + np.frombuffer(bytes(r.sums))
        return sums

    def sampled(self, rounds: list[Round], rates: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.enter("quality")
            for b in batches:
                for view, (x, got) in enumerate(_sampled(_unpacked(b), b.column("u").to_numpy(), b.column("v").to_numpy(), rounds, rates)):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), view)), pa.array(got), pa.array([r.tobytes() for r in x], pa.binary())], ["view", "good", "x"])

        found = sorted((r.view, r.good, bytes(r.x)) for r in self.rows.mapInArrow(run, "view long, good double, x binary").collect())
        out = []
        for view, width in ((0, _N_TEXT), (1, _N_META)):
            own = [f for f in found if f[0] == view]
            out.append((_stacked([x for _, _, x in own], width), np.array([g for _, g, _ in own])))
        return out


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [_stacked(common.as_bytes(batch.column(c)), n) for c, n in (("a", _N_TEXT), ("b", _N_META))]


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with both views' calibrated scores, the combined ``score`` and ``kept``.

    The columns in ``carry``, by default all, stay.
    """
    new = ("text_score", "meta_score", "score", "kept")
    own = [c for c in (docs.columns if carry is None else carry) if c not in new]
    model = fit(docs, labels, key, text, quality)
    if model is None:
        half = F.lit(0.5)
        return docs.select(*own, half.alias("text_score"), half.alias("meta_score"), half.alias("score"), F.lit(True).alias("kept"))
    carried = docs.select(*own).schema.fields
    inputs = _inputs(docs, own, text)
    schema = T.StructType([*carried, *(T.StructField(n, T.DoubleType()) for n in new[:3]), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            a, b, score = model(_views(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_{i}") for i in range(len(carried))), pa.array(a), pa.array(b), pa.array(score), pa.array(score >= threshold)], schema.names)

    return inputs.mapInArrow(run, schema)
