"""Ranked export, portal fields and progress figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import rules
from siftline.sources import ordinal

#: Fields that ``portal_ready`` sets.
PORTAL = ("final_score", "theory_novelty", "submission_value", "theory_explanation_zh", "recommendation_zh", "fit_reason", "risk_or_limitation", "scores_json")
SORT = ("rank_score", "score_overall_fit", "score_theory_novelty")


def sort_columns(fields: Sequence[str], order: str) -> list[Column]:
    """Fields descending, what is no number as 0, then input order."""
    return [*(tx.to_double(F.col(f)).desc() for f in fields), F.col(order).asc()]


def export(scored: DataFrame, columns: Sequence[str], top_k: int = 100, sort_by: Sequence[str] = SORT, order: str = "doc_id") -> DataFrame:
    """The first ``top_k`` rows with their 1-based rank.

    A short head is sorted in one task from the first rows of each partition; a long one by ranges.
    """
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    if top_k > rules.GATHERED:
        names = [f"_sort{i}" for i in range(len(sort_by))]
        keyed = scored.withColumns({n: tx.to_double(F.col(f)) for n, f in zip(names, sort_by, strict=True)})
        top = ordinal.numbered(keyed, [*names, order], "_place", descending=names).filter(F.col("_place") < top_k)
        return top.withColumn("rank", (F.col("_place") + 1).cast("int")).select("rank", *columns)
    keys = sort_columns(sort_by, order)
    top = scored.orderBy(*keys).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).select("rank", *columns)


def portal_ready(scored: DataFrame) -> DataFrame:
    """Field names that the portal import knows."""
    has = scored.columns
    text = lambda n: F.coalesce(F.col(n), F.lit("")) if n in has else F.lit("")
    score = F.coalesce(*(F.col(n) for n in ("rank_score", "score_overall_fit") if n in has), F.lit(0.0))
    return scored.withColumns(
        {
            "final_score": score,
            "theory_novelty": F.coalesce(F.col("score_theory_novelty"), F.lit(0.0)),
            "submission_value": F.coalesce(F.col("score_overall_fit"), F.lit(0.0)),
            "theory_explanation_zh": text("idea_core"),
            "recommendation_zh": text("transferable_mechanism"),
            "fit_reason": text("fit_reason"),
            "risk_or_limitation": text("risk_or_limitation"),
            **({"scores_json": F.to_json("scores")} if "scores" in has else {}),
        }
    )


def priority_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("priority", F.lit("UNKNOWN")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def top_groups(rows: DataFrame, by: Sequence[str], n: int = 20, order: str = "doc_id") -> DataFrame:
    """The largest groups; of equal ones the first seen first."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return out.orderBy(F.desc("n"), F.asc("first_seen")).limit(n)


def averages(rows: DataFrame, fields: Sequence[str] = SORT, digits: int = 3) -> DataFrame:
    """Means where nothing counts as 0 and what is no number not at all."""
    value = lambda f: F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), 0.0).otherwise(tx.to_double(F.col(f), None))
    return rows.agg(*(F.round(F.coalesce(F.avg(value(f)), F.lit(0.0)), digits).alias(f"avg_{f}") for f in fields))


def report(rows: DataFrame, target_total: int = 0, order: str = "doc_id") -> list[str]:
    """The progress figures as lines of text: a few rows, gathered after aggregation."""
    done = rows.count()
    out = [f"done = {done}" + (f" / {target_total}" if target_total else "")]
    if done:
        out.append("priority: " + str({r.priority: r.n for r in priority_counts(rows).orderBy(F.desc("n"), "priority").collect()}))
        out.append("venue_year: " + str({(r.venue, r.year): r.n for r in top_groups(rows, ("venue", "year"), 20, order).collect()}))
        means = averages(rows).first()
        out += [f"{f} {means[f'avg_{f}']}" for f in SORT]
        out.append(f"last item: {last_value(rows, 'title', order).first()[0]}")
    return out


def last_value(rows: DataFrame, field: str, order: str = "doc_id") -> DataFrame:
    return rows.agg(F.max_by(field, order).alias(field))
