"""Near-duplicates by bottom-k sketches from one hash function.

1. Every document becomes the set of its hashed five-word shingles.  Documents with equal sets
   form one class, and from here on a class is one node, however many copies it has.
2. A class's sketch is its K smallest hashes.  Two sets of similarity 0.75 share, but for a
   chance near 1e-9, at least ``OVERLAP`` of their sketches' values; sets of up to K shingles
   are their own sketches, and the bound is exact.  So, with a sketch's values ordered from
   rare to common, two such classes meet in the first ``size - OVERLAP + 1`` of them.  Only
   these go into the inverted lists; a passage that many documents share stands last and
   stays out.
3. Each list first proposes its members against two leaders, the one that shares most with
   others and the smallest, which is linear in the list.  The union sketch of a pair estimates
   its similarity and drops hopeless pairs; the full sets decide.  Linked classes merge into
   components.
4. Short lists then propose every pair whose members are still in different components.  The
   classes of longer lists with more than one component get lists anew, exact ones: over all
   their shingles, ordered from rare to common, linked sets meet in the rarest quarter.  A copy
   that was changed beyond the threshold has a rarest quarter of its own and is out; so is a
   page that shares but a passage.
5. These lists propose leaders, then pairs still in different components.  Members of a list meet
   only where their sizes and what they can still share leave room for a link, so pages of one template that
   differ in the rest do not meet at all.  No link between components is missed, and a list inside one
   component proposes nothing.

Joins and partial aggregates carry all of it, so Spark can split a hot list or class, and no
task holds a whole group.  Python only hashes words; sets are compared where Spark holds them, so
that no pair of sets is copied to a worker.

Defined results: words are runs of anything but white space, A-Z lower-cased; with fewer than
five words the whole sequence is one shingle; null and wordless texts have no shingles and are
linked with nothing; rows that share a key are judged each by its own text; a null key never is
the smallest of a component; an empty table stays empty; other columns are ignored.  Components
settle in about as many rounds as the longest chain of links has binary digits; should they not
within 50, that is an error and not a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common

SHINGLE = 5
K = 64
#: Values that two sketches of K share at least, where the sets' similarity is 0.75 or more.
OVERLAP = 26
#: Similarity from which documents are linked, in hundredths.
SIMILARITY = 75
#: Lists up to this length propose all their open pairs at once.
SHORT = 16
#: Words that a worker keeps the hashes of, and bytes of the longest of them.
MAX_WORDS, WORD_BYTES = 100_000, 64

SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("sketch", T.ArrayType(T.LongType(), False)),
    ]
)
FULL = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

_C = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

#: Sketches hold their hashes with this bit turned, so that Spark's signed order is the hashes' own.
_SIGN = np.uint64(1 << 63)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        n = xxhash.xxh64_intdigest(word)
        if len(word) <= WORD_BYTES:
            self[word] = n
        return n


_words = _Words()
common.cached("neardup", _words.clear)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    if n < 1:
        return _mix(np.array([(w * _C[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    h = w[:n] * _C[0]
    for i in range(1, SHINGLE):
        h += w[i : i + n] * _C[i]
    return np.unique(_mix(h))


def _node(found: np.ndarray) -> int | None:
    if not len(found):
        return None
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.enter("neardup")
    for batch in common.slices(batches, "text"):
        if len(_words) > MAX_WORDS:
            _words.clear()
        sets = [shingles(t) for t in common.as_bytes(batch.column("text"))]
        sketch = [(s[:K] ^ _SIGN).view(np.int64) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()), _lists(sketch), *batch.columns[2:]],
            SETS.names + batch.schema.names[2:],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.enter("neardup")
    for batch in common.slices(batches, "text"):
        if len(_words) > MAX_WORDS:
            _words.clear()
        sets = [shingles(t) for t in common.as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets])], FULL.names)


def _possible() -> Column:
    """Whether (n, most) and (m, most_other) leave room for the values a link needs in common."""
    return F.least("most", "most_other") * (100 + SIMILARITY) >= (F.col("n") + F.col("m")) * SIMILARITY


def _rarest(entries: DataFrame, least: Column, whole: Column) -> DataFrame:
    """(value, node, n, weight, most): each node's entries that a partner with ``least`` shared
    values cannot all avoid, the rarest first; ``weight`` sums how common a node's values are, and
    ``most`` bounds the values shared with a partner that is met here first, not in a rarer list.

    ``entries``: (node, n, held, value), ``held`` values for each node.  ``whole``: a node and
    all its possible partners have all their shingles here; else ``most`` is the node's size.
    """
    # written, so that the join has a plain shuffle on either side, of which Spark can split a hot value's part
    shared = common.materialize(entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "neardup-shared")
    held = entries.join(shared, "value").groupBy("node", "n", "held").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"), F.sum("df").alias("weight"))
    # values that no other node has are the rarest, and use up places of the prefix
    places = F.col("held") - least + 1 - (F.col("held") - F.size("common"))
    held = held.withColumn("places", places.cast("int")).filter("places > 0")
    entries = held.select("node", "n", "weight", F.size("common").alias("any"), F.posexplode(F.slice("common", F.lit(1), F.col("places"))).alias("at", "c"))
    # a pair first meets at its rarest shared value: all it shares stands there or after
    most = F.when(whole, (F.col("any") - F.col("at")).cast("long")).otherwise(F.col("n"))
    return entries.select(F.col("c.value").alias("value"), "node", "n", "weight", most.alias("most"))


def sketch_lists(classes: DataFrame) -> DataFrame:
    """Each class in the lists of its rarest retained values."""
    entries = classes.select("node", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    return _rarest(entries, F.least(F.ceil(F.col("n") * SIMILARITY / 100), F.lit(OVERLAP)), F.col("n") * 100 <= K * SIMILARITY)


def full_lists(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Each of ``nodes`` in the lists of its rarest shingles, counted among these nodes."""
    wanted = sets.join(nodes, "node", "left_semi")
    values = wanted.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("value"))
    return _rarest(values.withColumn("held", F.col("n")), F.ceil(F.col("n") * SIMILARITY / 100), F.lit(True))


def leader_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list against its member of most weight and its smallest one."""
    ends = lists.groupBy("value").agg(F.max(F.struct("weight", "node", "n", "most")).alias("w"), F.min(F.struct("n", "node", "most")).alias("s"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    leaders = ends.select("value", F.explode(F.array(*(F.struct(*(F.col(f"{e}.{c}") for c in ("node", "n", "most"))) for e in "ws"))).alias("e"))
    leaders = leaders.select("value", F.col("e.node").alias("other"), F.col("e.n").alias("m"), F.col("e.most").alias("most_other")).distinct()
    leaders = common.materialize(leaders, "neardup-leaders")
    pairs = lists.join(leaders, "value").filter((F.col("node") != F.col("other")) & _possible())
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of lists with more than one component: value, node, n, most, label, size."""
    placed = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("value").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("size")).filter("l < h").select("value", "size")
    mixed = common.materialize(mixed, "neardup-mixed-values")
    return placed.join(mixed, "value").select("value", "node", "n", "most", "label", "size")


def open_pairs(mixed: DataFrame) -> DataFrame:
    """All pairs of members of short lists that are in different components so far."""
    right = mixed.select("value", F.col("node").alias("other"), F.col("n").alias("m"), F.col("most").alias("most_other"), F.col("label").alias("other_label"))
    pairs = mixed.join(right, "value").filter((F.col("node") < F.col("other")) & (F.col("label") != F.col("other_label")) & _possible())
    return pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def _grade(n: Column) -> Column:
    """Sizes in grades of a twentieth."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05))).cast("int")


def open_pairs_by_size(mixed: DataFrame) -> DataFrame:
    """As ``open_pairs``, for lists of any length: members meet only where their sizes leave room.

    A member of size n that shares at most ``most`` values with whom it meets here can be linked with sizes
    up to most * (100 + SIMILARITY) / SIMILARITY - n, and from n * SIMILARITY / 100.  Most pages that share
    a template and have more of their own than a link allows reach no size at all, and so drop out before
    any two of them meet.  The larger member looks the grades of size that it reaches up.
    """
    reach = F.floor(F.col("most") * (100 + SIMILARITY) / SIMILARITY).cast("long") - F.col("n")
    least, most = F.ceil(F.col("n") * SIMILARITY / 100).cast("long"), F.least(F.col("n"), reach)
    larger = mixed.withColumn("grade", F.when(least <= most, F.sequence(_grade(least), _grade(most)))).filter("grade IS NOT NULL").withColumn("grade", F.explode("grade"))
    smaller = mixed.filter(reach >= F.col("n"))
    smaller = smaller.select("value", _grade(F.col("n")).alias("grade"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("most").alias("most_other"), F.col("label").alias("other_label"))
    ordered = (F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("other") < F.col("node"))
    pairs = larger.join(smaller, ["value", "grade"]).filter(ordered & (F.col("label") != F.col("other_label")) & _possible())
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that the union sketch, the K smallest of both sketches, leaves possible."""
    x = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    y = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    both = F.size(F.array_intersect("union", F.array_intersect("sa", "sb")))
    enough = F.when(F.size("union") < K, F.col("both") * 100 >= F.size("union") * SIMILARITY).otherwise(F.col("both") >= OVERLAP)
    return pairs.join(x, "a").join(y, "b").withColumn("union", union).withColumn("both", both).filter(enough).select("a", "b")


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes, from the text of one document each."""
    wanted = nodes.select("node").distinct().join(classes.select("node", "rep"), "node").select("rep").distinct()
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return texts.mapInArrow(_full_sets, FULL).groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked by their full sets."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # both >= SIMILARITY % of (n + m - both), with ``both`` once, so that no set is met twice
    enough = F.size(F.array_intersect("x", "y")) * (100 + SIMILARITY) >= (F.size("x").cast("long") + F.size("y")) * SIMILARITY
    return pairs.join(x, "a").join(y, "b").filter(enough).select("a", "b")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) of every linked node: alternating large-star and small-star steps.

    Each step is one aggregate and one join; the edges after it are written, so lineage does
    not grow with the rounds.
    """

    def step(edges: DataFrame, large: bool) -> DataFrame:
        # large-star: a node's larger neighbours go to its minimum; small-star: its smaller ones and itself
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(edges.select("b", "a")) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = both.join(least, "u")
        if large:
            return near.filter("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).filter("a != b").select("a", "b").distinct()
        moved = near.filter("v != m").select(F.col("v").alias("b"), F.col("m").alias("a")).select("a", "b")
        return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()

    if not links.take(1):
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    edges = common.materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    state = None
    for _ in range(rounds):
        before, edges = edges, common.materialize(step(step(edges, True), False), "cc")
        common.discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a"), F.col("a")).distinct())
        state = now
    raise RuntimeError("components did not settle")


def _merged(labels: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Labels after the links among ``pairs`` too."""
    if not pairs.take(1):
        return labels
    links = common.materialize(confirmed(pairs, sets), "neardup-links")
    out = components(links.union(labels.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")))) if links.take(1) else labels
    common.discard(links)
    return out


def text_hash(text: Column) -> Column:
    """What stands for a text in ``classify(..., by_text=True)``."""
    return F.md5(text.cast("string").cast("binary"))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", by_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest key reachable by links, its own
    included) and kept (it has that key).

    ``by_text``: also the row's ``text_hash`` and ``linked``, one number for all rows of a component,
    null where the text has no shingles.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    more = ["text_hash"] if by_text else []
    hashed = rows.withColumn("text_hash", text_hash(F.col("text"))) if by_text else rows
    sets = common.materialize(hashed.mapInArrow(_sketches, T.StructType([*SETS, *(hashed.schema[c] for c in more)])), "neardup-sketches")
    classes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = common.materialize(classes, "neardup-classes")
    lists = common.materialize(sketch_lists(classes), "neardup-lists")
    sets_of = common.materialize(full_sets(lists, classes, rows), "neardup-sets")

    first = common.materialize(estimated(leader_pairs(lists), classes), "neardup-pairs")
    links = common.materialize(confirmed(first, sets_of), "neardup-links")
    labels = components(links)

    mixed = common.materialize(mixed_lists(lists, labels), "neardup-mixed")
    pairs = open_pairs(mixed.filter(F.col("size") <= SHORT))
    exact = None
    if mixed.filter(F.col("size") > SHORT).take(1):
        exact = common.materialize(full_lists(mixed.filter(F.col("size") > SHORT), sets_of), "neardup-exact")
        pairs = pairs.union(leader_pairs(exact)).distinct()
    second = common.materialize(estimated(pairs.join(first, ["a", "b"], "left_anti"), classes), "neardup-pairs")
    labels = _merged(labels, second, sets_of)
    if exact is not None:
        pairs = open_pairs_by_size(mixed_lists(exact, labels)).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
        third = common.materialize(estimated(pairs, classes), "neardup-pairs")
        labels = _merged(labels, third, sets_of)
        common.discard(exact, third)
    common.discard(lists, sets_of, first, mixed, second)

    labelled = classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = labelled.join(least, "label").select("node", "component_id", "label")
    out = sets.select("doc_id", "n_shingles", "node", *more).join(found, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    more += [F.col("label").alias("linked")] if by_text else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more)
