"""Rule filter: keyword scores, first-wins dedup, threshold and cap."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.sources import ordinal

#: Points of a phrase and of a single word, and what a negative point costs.
PHRASE, WORD, PENALTY = 1.5, 1.0, 1.25
#: Rows that a sorted head may have in one task; a longer one is numbered by files.
GATHERED = 10_000


def bound(frame: DataFrame, name: str, value: Column, of) -> DataFrame:
    """``frame`` with column ``name``: ``of(value)``, where ``value`` is worked out once a row.

    A filter on a plain column would be pushed below it and would repeat ``value`` wherever ``of``
    names it.  No filter passes a row's running number and no projection is merged with one that has
    it, and all stays in generated code.  The number itself, never below 0, decides nothing.
    """
    held = frame.withColumn("_bound", F.when(F.monotonically_increasing_id() >= 0, value))
    return held.select(*frame.columns, of(F.col("_bound")).alias(name))


def _keywords(words: Iterable[str]) -> list[tuple[str, str]]:
    """(needle, as spelled) of the keywords that are not blank; lowered once, on the driver."""
    return [(w.strip().lower(), w) for w in words if w.strip()]


def _points(blob: Column, words: Iterable[str]) -> Column:
    arms = [F.when(blob.contains(k), F.lit(PHRASE if " " in k else WORD)).otherwise(F.lit(0.0)) for k, _ in _keywords(words)]
    return reduce(lambda a, b: a + b, arms, F.lit(0.0))


def _hits(blob: Column, words: Iterable[str]) -> Column:
    arms = [F.when(blob.contains(k), F.lit(w)) for k, w in _keywords(words)]
    return F.array_compact(F.array(*arms)) if arms else F.array().cast("array<string>")


def score(papers: DataFrame, positive: Sequence[str], negative: Sequence[str], fields: Sequence[str] = ("title", "abstract", "keywords")) -> DataFrame:
    """``papers`` with rule_score, its parts and the matched keywords in profile order."""

    def parts(blob: Column) -> Column:
        up, down = _points(blob, positive), _points(blob, negative)
        return F.struct(
            up.alias("rule_positive_score"),
            down.alias("rule_negative_score"),
            _hits(blob, positive).alias("rule_positive_hits"),
            _hits(blob, negative).alias("rule_negative_hits"),
            F.round(up - F.lit(PENALTY) * down, 4).alias("rule_score"),
        )

    new = ("rule_positive_score", "rule_negative_score", "rule_positive_hits", "rule_negative_hits", "rule_score")
    out = bound(papers, "_rule", tx.search_blob(*(F.col(f) for f in fields)), parts)
    return out.select(*(c for c in papers.columns if c not in new), *(F.col(f"_rule.{c}").alias(c) for c in new))


def keyword_counts(papers: DataFrame, words: Sequence[str], fields: Sequence[str] = ("title", "abstract", "keywords")) -> DataFrame:
    """(keyword, papers that contain it): one pass, the keyword table being the literal list."""
    hits = bound(papers, "_hits", tx.search_blob(*(F.col(f) for f in fields)), lambda blob: F.array_distinct(_hits(blob, words)))
    found = hits.select(F.explode("_hits").alias("keyword"))
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_papers"))


def in_years(papers: DataFrame, years: Sequence[int], year: str = "year") -> DataFrame:
    """Rows of the given years; no years means no filter, an unreadable year goes."""
    return papers.filter(tx.to_int(F.col(year)).isin(*years)) if years else papers


def first_wins(papers: DataFrame, key: str | Column, order: str | Column) -> DataFrame:
    """The first row of each key in input order; ``order`` is expected to be unique."""
    order = F.col(order) if isinstance(order, str) else order
    w = Window.partitionBy(key).orderBy(order.asc())
    return papers.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def placed(scored: DataFrame, min_score: float = 1.0, title: str = "title", order: str = "doc_id") -> DataFrame:
    """Rows at or above the threshold with their ``place`` in keep order, from 0: the score, then the
    title, both descending, then input order.  Sorted by ranges, in files; any number of rows."""
    return ordinal.numbered(scored.filter(F.col("rule_score") >= min_score), ["rule_score", title, order], "place", descending=["rule_score", title])


def kept(scored: DataFrame, min_score: float = 1.0, target_total: int = 0, title: str = "title", order: str = "doc_id") -> DataFrame:
    """Rows at or above the threshold in keep order, at most ``target_total`` if positive."""
    sort = (F.desc("rule_score"), F.desc(title), F.asc(order))
    if target_total > GATHERED:
        return placed(scored, min_score, title, order).filter(F.col("place") < target_total).drop("place").orderBy(*sort)
    out = scored.filter(F.col("rule_score") >= min_score).orderBy(*sort)
    return out.limit(target_total) if target_total > 0 else out


def ranked(scored: DataFrame, top: int, min_score: float = 1.0, title: str = "title", order: str = "doc_id") -> DataFrame:
    """The first ``top`` kept rows with their place, from 1.

    Only those rows are numbered, so the window that needs them in one task is bounded by ``top``.
    """
    w = Window.orderBy(F.desc("rule_score"), F.desc(title), F.asc(order))
    return kept(scored, min_score, top, title, order).withColumn("place", F.row_number().over(w))


def rejected(scored: DataFrame, min_score: float = 1.0, target_total: int = 0, title: str = "title", order: str = "doc_id") -> DataFrame:
    """What ``kept`` leaves, with the part it comes from: overflow of the cap, or below the threshold.

    With a cap ``scored`` is read twice; write it before, so that rows are scored once.  Up to
    ``GATHERED`` rows, the last that is kept parts the rest: no join by key and no second sort.
    """
    passed = F.col("rule_score") >= min_score
    below = scored.filter(~passed).withColumn("part", F.lit("below"))
    if target_total <= 0:
        return below
    if target_total > GATHERED:
        over = placed(scored, min_score, title, order).filter(F.col("place") >= target_total).drop("place")
        return over.withColumn("part", F.lit("overflow")).unionByName(below)
    place = F.struct(F.col("rule_score").alias("s"), F.col(title).alias("t"))
    last = ranked(scored.select("rule_score", title, order), target_total, min_score, title, order).agg(F.max_by(F.struct(place.alias("p"), F.col(order).alias("o")), "place").alias("_last"))
    beyond = (place < F.col("_last.p")) | (place.eqNullSafe(F.col("_last.p")) & (F.col(order) > F.col("_last.o")))
    part = F.when(~passed, "below").when(beyond, "overflow")
    return scored.crossJoin(F.broadcast(last)).withColumn("part", part).filter("part IS NOT NULL").drop("_last")


def summary(scored: DataFrame, profile: str, min_score: float = 1.0, target_total: int = 0) -> DataFrame:
    """One row: profile, kept, rejected."""
    n = F.count_if(F.col("rule_score") >= min_score)
    keep = F.least(n, F.lit(target_total).cast("long")) if target_total > 0 else n
    return scored.agg(keep.cast("long").alias("kept"), (F.count(F.lit(1)) - keep).cast("long").alias("rejected")).select(F.lit(profile).alias("profile"), "kept", "rejected")


def venue_years(rows: DataFrame) -> DataFrame:
    """(venue_year, n): groups named ``venue::year``, null as None."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return rows.groupBy(F.concat_ws("::", name("venue"), name("year")).alias("venue_year")).agg(F.count(F.lit(1)).alias("n"))
