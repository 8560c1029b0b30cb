"""Hard negatives by bit-sliced integer products.

Vectors become whole numbers, floor(256 x).  Rows are packed in blocks, and a block holds its numbers
by bit-planes, the sign's first: plane b has one bit of every component of every row.  The product of
an anchor with the bits of a plane, times the plane's weight, adds to a score; what the planes to
come can still add lies between the anchor's negative and its positive components times
2^b - 1.  So every plane narrows the interval of a score, and a candidate is dropped once its interval
says that it cannot be wanted: below the k-th best lower bound of its anchor, or outside all
windows of it.  While many candidates are left, planes are multiplied for the block whole; the few that
stay are then finished one by one.  The last plane makes the scores exact.

Pass one finds each anchor's positives, the k best other rows of its label.  Pass two finds, for the window of
scores that each positive gives, the best rows of other labels.  In both, every block of rows
meets every block of anchors (a stated set of queries); a task keeps the best of the anchor blocks it has
met last and hands on a few rows an anchor, which Spark ranks.  Blocks are bounded in rows, so the
memory of a task is, whatever the number of rows, anchors or the size of a label.

Defined results: a row with a null id, label or vector, an empty vector, or a component that is null, not finite or
65,536 or more in size takes no part; a vector meets a shorter one on the components that both have;
rows of equal score go by id; rows that share an id are candidates each, but none is another row to an
anchor of that id, and anchors that share an id are one anchor, with the smallest label and then
the smallest vector; without positives or negatives an anchor gives no rows; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common

SCALE = 256
#: Components of this size or more would leave no room for a score in 64 bits.
MOST = 1 << 16
POSITIVES, NEGATIVES = 5, 10
#: Hundredths of a positive's score between which a hard negative's lies.
LOW, HIGH = 30, 90
#: Below every score; its negative is above all.
NOTHING = -(1 << 62)
#: Share of candidates left from which they are finished one by one.
FEW = 1 / 64
#: Planes to come from which intervals are narrow enough to rank candidates that meet an anchor first.
SOON = 6
#: Pairs that are finished at once.
PAIRS = 1 << 16



@dataclass(frozen=True)
class Blocks:
    """Rows in a block of rows, anchors in a block of anchors, and anchor blocks whose best
    candidates a task keeps at once."""

    rows: int = 4096
    anchors: int = 256
    kept: int = 64


PACKED = T.StructType(
    [
        T.StructField("dims", T.LongType()),
        T.StructField("planes", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("labels", T.BinaryType()),
        T.StructField("bits", T.BinaryType()),
    ]
)
ANCHOR_BLOCK = T.StructType([T.StructField("anchors", T.StringType()), T.StructField("width", T.LongType())] + [T.StructField(n, T.BinaryType()) for n in ("anchor_ids", "anchor_labels", "numbers", "lows", "highs")])
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_id", "vec_id", "score")])


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the vectors that take part, and their components as whole numbers."""
    places, found = [], []
    for i, v in enumerate(vectors):
        if not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all() and (np.abs(x) < MOST).all():
            places.append(i)
            found.append(np.floor(x * SCALE).astype(np.int64))
    return np.array(places, np.int64), found


def planes_of(numbers: np.ndarray) -> tuple[int, bytes]:
    """Number of bit-planes of two's complement, and the planes, the sign's first; each holds the
    bits of one row after another, rows in whole bytes."""
    count = int(np.where(numbers < 0, ~numbers, numbers).max(initial=0)).bit_length() + 1
    return count, b"".join(np.packbits((numbers >> b & 1).astype(np.uint8), axis=1).tobytes() for b in range(count - 1, -1, -1))


def plane(bits: np.ndarray, at: int, rows: np.ndarray, dims: int) -> np.ndarray:
    """The bits of plane ``at`` (0: the sign's) of the given rows."""
    return np.unpackbits(bits[at, rows], axis=1, count=dims)


def _stacked(numbers: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(numbers), max(map(len, numbers), default=0)), np.int64)
    for row, x in zip(out, numbers, strict=True):
        row[: len(x)] = x
    return out


Packer = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _pack_rows(most: int) -> Packer:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        size = 0

        def block(rows: int) -> pa.RecordBatch:
            nonlocal held, size
            ids, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            numbers = [x for h in held for x in h[2]]
            stacked = _stacked(numbers[:rows])
            planes, bits = planes_of(stacked)
            held, size = [(ids[rows:], labels[rows:], numbers[rows:])], len(ids) - rows
            out = [stacked.shape[1], planes, ids[:rows].astype("<i8").tobytes(), labels[:rows].astype("<i8").tobytes(), bits]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in out], PACKED.names)

        for batch in batches:
            places, numbers = whole_numbers(batch.column("vec"))
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[places] for c in ("id", "label"))
            held.append((ids, labels, numbers))
            size += len(places)
            while size >= most:
                yield block(most)
        if size:
            yield block(size)

    return run


def _pack_anchors(most: int) -> Packer:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                some = batch.slice(lo, most)
                numbers = _stacked([np.array(x, np.int64) for x in some.column("numbers").to_pylist()])
                ids, labels = (some.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in ("anchor_id", "label"))
                # windows in which no score lies fill up the rows
                windows = [[(w["low"], w["high"]) for w in ws] for ws in some.column("windows").to_pylist()]
                widest = max(map(len, windows))
                bounds = np.array([ws + [(1, 0)] * (widest - len(ws)) for ws in windows], "<i8").reshape(len(windows), widest, 2)
                row = [f"{part}/{n}", numbers.shape[1], ids, labels, numbers.astype("<i8").tobytes(), bounds[:, :, 0].tobytes(), bounds[:, :, 1].tobytes()]
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ANCHOR_BLOCK.names)

    return run


class _Best:
    """The best candidates so far of each anchor of a block and each of its windows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int):
        self.ids, self.labels, self.lows, self.highs, self.k = ids, labels, lows, highs, k
        n, w = lows.shape
        #: (-score, id) in ascending order; places beyond ``size`` are empty
        self.scores = np.zeros((n, w, k), np.int64)
        self.rows = np.zeros((n, w, k), np.int64)
        self.size = np.zeros((n, w), np.int64)

    def least(self) -> np.ndarray:
        """The score that a candidate must reach, by anchor and window; anything will do while there is room."""
        return np.where(self.size == self.k, self.scores[:, :, -1], NOTHING)

    def add(self, anchor: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Candidates with exact scores; of each anchor and window the ``k`` best stay."""
        for w in range(self.lows.shape[1]):
            inside = (score >= self.lows[anchor, w]) & (score <= self.highs[anchor, w]) & (score >= self.least()[anchor, w])
            a, r, s = anchor[inside], row[inside], score[inside]
            for i in np.unique(a):
                mine, had = a == i, self.size[i, w]
                s_all = np.concatenate((self.scores[i, w, :had], s[mine]))
                r_all = np.concatenate((self.rows[i, w, :had], r[mine]))
                first = np.lexsort((r_all, -s_all))[: self.k]
                self.size[i, w] = len(first)
                self.scores[i, w, : len(first)], self.rows[i, w, : len(first)] = s_all[first], r_all[first]

    def out(self) -> pa.RecordBatch:
        # a row may be best of several windows, and may stand in one several times
        anchor, window, at = np.nonzero(np.arange(self.k) < self.size[:, :, None])
        found: dict[tuple[int, int, int], dict[int, int]] = {}
        for i, w, row, score in zip(anchor.tolist(), window.tolist(), self.rows[anchor, window, at].tolist(), self.scores[anchor, window, at].tolist(), strict=True):
            times = found.setdefault((i, row, score), {})
            times[w] = times.get(w, 0) + 1
        rows = [(int(self.ids[i]), row, score) for (i, row, score), times in found.items() for _ in range(max(times.values()))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], FOUND.names)


def narrow(best: _Best, numbers: np.ndarray, bits: np.ndarray, dims: int, wanted: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the candidates that no interval has dropped, with exact scores.

    ``numbers``: the anchors' components.  ``bits``: planes x rows x bytes.  ``wanted``: anchors x
    rows, whether the row is a candidate.  ``rows``: the rows' ids, by which equal scores go.
    """
    planes, n = bits.shape[:2]
    # 53 bits hold every sum, or else whole numbers of 64 bits do
    exact = np.float64 if np.abs(numbers).sum(axis=1).max(initial=0) * float(1 << planes) < 2.0**53 else np.int64
    a = numbers.astype(exact)
    up, down = a.clip(min=0).sum(axis=1)[:, None], a.clip(max=0).sum(axis=1)[:, None]
    least = best.least()
    alive, active, score = np.arange(n), wanted, np.zeros((len(a), n), exact)
    for at in range(planes):
        b = planes - 1 - at
        if not active.any():
            return (np.empty(0, np.int64),) * 3
        if active.mean() < FEW:
            return _finish(a, bits, dims, alive, *np.nonzero(active), score, at)
        weight = -(1 << b) if at == 0 else 1 << b
        score = score + (a @ plane(bits, at, alive, dims).astype(exact).T) * weight
        rest = (1 << b) - 1
        low, high = score + rest * down, score + rest * up
        possible = np.zeros_like(active)
        for w in range(best.lows.shape[1]):
            lo, hi = best.lows[:, w, None], best.highs[:, w, None]
            within = active & (high >= lo) & (low <= hi)
            bar = least[:, w].astype(exact)
            if (room := np.flatnonzero(bar == NOTHING)).size and low.shape[1] >= best.k and b < SOON:
                # ``k`` certain candidates reach this score, so that what stays below is none of the best
                sure = np.where(active[room] & (low[room] >= lo[room]) & (high[room] <= hi[room]), low[room], exact(NOTHING))
                bar[room] = np.partition(sure, -best.k, axis=1)[:, -best.k]
            possible |= within & (high >= bar[:, None])
        columns = possible.any(axis=0)
        if columns.mean() < 0.75:
            alive, score, possible = alive[columns], score[:, columns], possible[:, columns]
        active = possible
    i, j = np.nonzero(active)
    return i, alive[j], score[i, j].astype(np.int64)


def _finish(a: np.ndarray, bits: np.ndarray, dims: int, alive: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact scores of single pairs from plane ``at`` on."""
    planes, out = bits.shape[0], score[i, j]
    rows = alive[j]
    for lo in range(0, len(i), PAIRS):
        some = slice(lo, lo + PAIRS)
        for p in range(at, planes):
            weight = -(1 << (planes - 1 - p)) if p == 0 else 1 << (planes - 1 - p)
            out[some] += np.einsum("pd,pd->p", a[i[some]], plane(bits, p, rows[some], dims).astype(a.dtype)) * weight
    return i, rows, out.astype(np.int64)


def _meet(same: bool, k: int, most_kept: int) -> Packer:
    """What each task does with pairs of blocks; ``same``: candidates have the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[_Best, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["anchors"] not in kept:
                    if len(kept) >= most_kept:
                        yield kept.pop(next(iter(kept)))[0].out()
                    ids, labels = (np.frombuffer(r[c], "<i8") for c in ("anchor_ids", "anchor_labels"))
                    lows, highs = (np.frombuffer(r[c], "<i8").reshape(len(ids), -1) for c in ("lows", "highs"))
                    kept[r["anchors"]] = _Best(ids, labels, lows, highs, k), np.frombuffer(r["numbers"], "<i8").reshape(len(ids), -1)
                best, numbers = kept[r["anchors"]]
                rows, labels = (np.frombuffer(r[c], "<i8") for c in ("ids", "labels"))
                dims = r["dims"]
                bits = np.frombuffer(r["bits"], np.uint8).reshape(r["planes"], len(rows), -1)
                both = np.zeros((len(numbers), dims), np.int64)
                both[:, : min(dims, r["width"])] = numbers[:, :dims]
                # labels in turn, so that only rows of an anchor's label are multiplied
                groups = np.unique(best.labels) if same else [None]
                for label in groups:
                    at = np.flatnonzero(best.labels == label) if same else np.arange(len(both))
                    of = np.flatnonzero(labels == label) if same else np.arange(len(rows))
                    if not len(of):
                        continue
                    part = best if not same else _part(best, at)
                    other = rows[of][None, :] != best.ids[at][:, None]
                    wanted = other if same else other & (labels[None, :] != best.labels[:, None])
                    i, j, score = narrow(part, both[at], bits[:, of], dims, wanted, rows[of])
                    best.add(at[i], rows[of][j], score)
        for best, _ in kept.values():
            yield best.out()

    return run


def _part(best: _Best, at: np.ndarray) -> _Best:
    out = _Best(best.ids[at], best.labels[at], best.lows[at], best.highs[at], best.k)
    out.scores, out.rows, out.size = best.scores[at], best.rows[at], best.size[at]
    return out


def _candidates(packed: DataFrame, anchors: DataFrame, same: bool, k: int, blocks: Blocks, name: str) -> DataFrame:
    """(anchor_id, vec_id, score): of each anchor and window, each task's best ``k``."""
    asked = common.materialize(anchors.mapInArrow(_pack_anchors(blocks.anchors), ANCHOR_BLOCK), f"bits-{name}-anchors")
    return common.materialize(packed.crossJoin(asked).mapInArrow(_meet(same, k, blocks.kept), FOUND), f"bits-{name}")


def moved_label(key: Column, label: Column) -> Column:
    """Labels as they are mined: of every seventh id the next of ten."""
    return F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    key: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    blocks: Blocks = Blocks(),
) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of other labels whose score is from ``low``
    to ``high`` hundredths of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vec"), is_anchor.alias("is_anchor")).filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    packed = common.materialize(rows.drop("is_anchor").mapInArrow(_pack_rows(blocks.rows), PACKED), "bits-rows")
    # the checks of whole_numbers as expressions: anchors are few
    fit = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * SCALE))
    anchors = rows.filter("is_anchor").filter(fit).select(F.col("id").alias("anchor_id"), F.struct("label", whole.alias("numbers")).alias("a")).groupBy("anchor_id").agg(F.min("a").alias("a"))
    anchors = common.materialize(anchors.select("anchor_id", "a.label", "a.numbers"), "bits-anchors")

    every = F.array(F.struct(F.lit(NOTHING).alias("low"), F.lit(-NOTHING).alias("high")))
    near = _candidates(packed, anchors.withColumn("windows", every), True, positives, blocks, "positives")
    place = lambda by, score, row: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(row)))
    near = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = common.materialize(near.withColumn("_place", place(("anchor_id",), "positive_score", "positive_id")).filter(F.col("_place") <= positives).drop("_place"), "bits-near")

    # 100 * score from low to high times the positive's, in whole scores
    window = F.struct(F.expr(f"(positive_score * {low} + pmod(-positive_score * {low}, 100)) div 100").alias("low"), F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100").alias("high"))
    windows = near.withColumn("w", window).groupBy("anchor_id").agg(F.collect_set("w").alias("windows"))
    far = _candidates(packed, anchors.join(windows, "anchor_id"), False, negatives, blocks, "negatives")
    far = far.select("anchor_id", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    inside = (F.col("negative_score") * 100 >= F.col("positive_score") * low) & (F.col("negative_score") * 100 <= F.col("positive_score") * high)
    placed = near.join(far, "anchor_id").filter(inside)
    ranked = placed.withColumn("rank", place(("anchor_id", "positive_id"), "negative_score", "negative_id")).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """``mine`` with every hundredth id as anchor and moved labels."""
    return mine(vectors, F.col("vec_id") % 100 == 0, label=moved_label(F.col("vec_id"), F.col("label")), blocks=blocks)


#: DuckDB's form of ``hard_negatives`` over ``embeddings``.
ORACLE = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
