"""The article portal: import mapping and the frames behind its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import rules, textindex
from siftline.sources.ordinal import numbered  # noqa: F401  (articles need one)

# Where each column of an article comes from, first filled one first.
TEXTS = {
    "title": ("title",),
    "abstract": ("abstract",),
    "venue": ("venue",),
    "url": ("url", "pdf_url"),
    "authors": ("authors",),
    "priority": ("priority", "light_priority"),
    "profile_name": ("profile_name",),
    "idea_core": ("idea_core", "theory_analysis_zh_md"),
    "transferable_mechanism": ("transferable_mechanism", "theory_used_how_zh_md"),
    "fit_reason": ("fit_reason", "recommendation_zh"),
    "risk_or_limitation": ("risk_or_limitation", "deep_risk_reason_zh"),
}
SCORES = {
    "rank_score": ("rank_score", "final_score", "rank_score_wp2_accent"),
    "score_overall_fit": ("score_overall_fit", "deep_overall_recommendation_score"),
    "score_theory_novelty": ("score_theory_novelty", "deep_theory_novelty_score"),
}
#: Fields that a search looks through; ``raw_url`` is the record's own url, without the fallback.
SEARCHED = ("title", "abstract", "venue", "year", "idea_core", "transferable_mechanism", "fit_reason", "risk_or_limitation", "theory_bucket", "theory_family", "profile_name", "raw_url")
FIXED_ITEMS = (("Rank score", "rank_score"), ("Overall fit", "score_overall_fit"), ("Theory novelty", "score_theory_novelty"))
#: Flat scores that are columns of their own.
GLOBAL = ("score_overall_fit", "score_theory_novelty")
SORTS = {"rank_score": "rank_score", "overall": "score_overall_fit", "novelty": "score_theory_novelty", "year": "year"}
HIGH = 7.0
#: Stands for an empty field on a page.
NOTHING = "N/A"
MOST_LISTED = 1000


def articles(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """Import mapping: one article for each row, ``id`` its order value plus one.

    ``order`` is a whole number that no two rows share; ``numbered`` makes one.  ``raw_json`` is the
    whole record, and what a search reads of it stands in columns of its own beside it.
    """
    has = rows.columns

    def text(names: tuple[str, ...]) -> Column:
        return tx.first_text(*(F.col(n).cast("string") for n in names if n in has)) if any(n in has for n in names) else F.lit("")

    def number(names: tuple[str, ...]) -> Column:
        return tx.first_number(*(tx.to_double(F.col(n)) for n in names if n in has)) if any(n in has for n in names) else F.lit(0.0)

    out = {n: text(s) for n, s in TEXTS.items()}
    out["priority"] = tx.first_text(out["priority"], F.lit("maybe"))
    out["year"] = tx.to_int(F.col("year"), 0).cast("int") if "year" in has else F.lit(0)
    scores = F.to_json("scores") if "scores" in has else F.lit("{}")
    raw = F.col("raw") if "raw" in has else F.to_json(F.struct(*has), {"ignoreNullFields": "false"})
    beside = {"theory_bucket": text(("theory_bucket",)), "theory_family": text(("theory_family",)), "raw_url": text(("url",)), "raw_json": raw}
    return rows.select(
        (F.col(order) + 1).alias("id"),
        *(c.alias(n) for n, c in out.items()),
        *(number(s).alias(n) for n, s in SCORES.items()),
        F.coalesce(scores, F.lit("{}")).alias("scores_json"),
        *(c.alias(n) for n, c in beside.items()),
    )


def search_blob(found: DataFrame) -> Column:
    """What a search of articles looks through, lower-cased; empty fields leave no separator."""
    parts = (F.when(F.col(c) != 0, F.col(c).cast("string")) if c == "year" else tx.blank_to_null(F.col(c)) for c in SEARCHED if c in found.columns)
    return F.lower(F.concat_ws(" ", *parts))


def search(found: DataFrame, q: str = "", priority: str = "", sort: str = "rank_score", limit: int = 100, index: str = "") -> DataFrame:
    """Substring search over the text fields, priority filter, sort and page limit.

    ``index``: a folder that ``textindex.build`` has written of these articles' ``search_blob``; texts
    that cannot hold ``q`` are then not read.
    """
    if not 1 <= limit <= MOST_LISTED:
        raise ValueError(f"limit must be from 1 to {MOST_LISTED}")
    q, priority = q.strip().lower(), priority.strip().lower()
    if q and index:
        found = found.join(textindex.texts_with(found.sparkSession, index, q).select("id"), "id", "left_semi")
    elif q:
        found = rules.bound(found, "_hit", search_blob(found), lambda blob: blob.contains(q)).filter("_hit").drop("_hit")
    if priority:
        found = found.filter(F.lower("priority") == priority)
    return found.orderBy(F.desc(SORTS.get(sort, "rank_score")), F.asc("id")).limit(limit)


def detail(found: DataFrame, id: int) -> DataFrame:
    return found.filter(F.col("id") == id).limit(1)


def shown(found: DataFrame) -> DataFrame:
    """What the pages show of each article: a stand-in for every empty field, scores with two digits.

    Scores are rounded half up on their decimal text, as everywhere here.
    """
    text = lambda names, empty: tx.first_text(*(F.col(n).cast("string") for n in names), F.lit(empty))
    score = lambda n: F.format_string("%.2f", F.coalesce(F.col(n), F.lit(0.0)))
    return found.select(
        "id",
        *(text((n,), NOTHING).alias(n) for n in ("authors", "venue", "idea_core", "transferable_mechanism", "fit_reason", "risk_or_limitation")),
        F.when(F.coalesce(F.col("year"), F.lit(0)) != 0, F.col("year").cast("string")).otherwise(NOTHING).alias("year"),
        text(("priority",), "maybe").alias("priority"),
        text(("profile_name",), "profile").alias("profile_name"),
        text(("abstract",), "No abstract available.").alias("abstract"),
        text(("idea_core", "transferable_mechanism"), "No idea summary available.").alias("summary"),
        score("rank_score").alias("rank"),
        score("score_overall_fit").alias("overall"),
    )


def home_partial(found: DataFrame) -> DataFrame:
    """One row, to be merged with those of other articles: counts, sum and maximum."""
    rank = F.coalesce("rank_score", F.lit(0.0))
    return found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.lower("priority") == "keep").alias("keep"), F.sum(rank).alias("sum_rank"), F.max(rank).alias("max_rank"))


def home_merged(partial: DataFrame) -> DataFrame:
    """One row: articles, those to keep, mean and highest rank score."""
    total = F.coalesce(F.sum("total"), F.lit(0))
    return partial.agg(
        total.alias("total"),
        F.coalesce(F.sum("keep"), F.lit(0)).alias("keep"),
        F.when(total > 0, F.sum("sum_rank") / total).otherwise(0.0).alias("avg_rank"),
        F.coalesce(F.max("max_rank"), F.lit(0.0)).alias("max_rank"),
    )


def home(found: DataFrame) -> DataFrame:
    """One row: articles, those to keep, mean and highest rank score."""
    return home_merged(home_partial(found))


def top_papers(found: DataFrame, n: int = 8) -> DataFrame:
    return found.orderBy(F.desc("rank_score"), F.asc("id")).limit(n)


def _map(name: str) -> Column:
    """A JSON column as text by key; nothing, or what is no object, is the empty map."""
    return F.coalesce(F.from_json(name, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _flat(raw: Column) -> Column:
    """The flat scores of a record, by their names in it."""
    return F.map_filter(raw, lambda k, _: k.startswith("score_") & ~k.isin(*GLOBAL))


def _number(value: Column) -> Column:
    """Nothing is 0; null for what is no number."""
    return F.when(value.isNull() | (value == ""), 0.0).when(value.isin("true", "false"), (value == "true").cast("double")).otherwise(tx.to_double(value, None))


def score_value(found: DataFrame, key: str) -> Column:
    """An article's score: the column, or the record's member where that is null; 0 where it is no number."""
    raw = _number(F.element_at(_map("raw_json"), key)) if "raw_json" in found.columns else F.lit(None).cast("double")
    return F.coalesce(F.col(key).cast("double") if key in found.columns else F.lit(None).cast("double"), raw, F.lit(0.0))


def dimension_partial(found: DataFrame) -> DataFrame:
    """A row for each dimension, to be merged with those of other articles: number, sum and high ones of
    the score maps' values, and where the dimension first appears."""
    flat = F.map_entries(_flat(_map("raw_json"))) if "raw_json" in found.columns else F.array().cast("array<struct<key:string,value:string>>")
    own = F.transform(F.map_entries(_map("scores_json")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(False).alias("flat")))
    more = F.transform(flat, lambda e: F.struct(F.replace(e["key"], F.lit("score_"), F.lit("")).alias("key"), e["value"].alias("value"), F.lit(True).alias("flat")))
    each = found.select("id", F.posexplode(F.concat(own, more)).alias("place", "e")).select("id", "place", "e.key", "e.value", "e.flat")
    # flat values gather with the rest: one shuffle, and per dimension only the first of them is held
    number = _number(F.col("value"))
    return each.groupBy("key").agg(
        F.min(F.struct("id", "place", "flat", number.alias("v"))).alias("f"),
        F.count(F.when(~F.col("flat"), number)).alias("c"),
        F.coalesce(F.sum(F.when(~F.col("flat"), number)), F.lit(0.0)).alias("s"),
        F.count_if(~F.col("flat") & (number >= HIGH)).alias("h"),
    )


def dimension_merged(partial: DataFrame, n: int = 12, merge: bool = True) -> DataFrame:
    """``dimension_stats`` of the articles that ``partial`` is of."""
    stats = partial.groupBy("key").agg(F.min("f").alias("f"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("h").alias("h")) if merge else partial
    lone = F.col("f.flat") & F.col("f.v").isNotNull()
    count = F.col("c") + lone.cast("long")
    stats = stats.filter(count > 0).select(
        "key",
        tx.title_case_label(F.col("key")).alias("label"),
        ((F.col("s") + F.when(lone, F.col("f.v")).otherwise(0.0)) / count).alias("avg"),
        (F.col("h") + (lone & (F.col("f.v") >= HIGH)).cast("long")).alias("high"),
        F.col("f.id").alias("_id"),
        F.col("f.place").alias("_place"),
    )
    return stats.orderBy(F.desc("avg"), F.desc("high"), "_id", "_place").limit(n).drop("_id", "_place")


def dimension_stats(found: DataFrame, n: int = 12) -> DataFrame:
    """Mean and number of high values of each dimension, the strongest first, then the first seen.

    A dimension's values are those of all score maps.  A flat ``score_`` member of a record counts
    only in the first article in which its dimension appears at all, and only if that article's map
    has it not.  A null value is 0; one that is no number counts for nothing.
    """
    return dimension_merged(dimension_partial(found), n, merge=False)


def score_items(found: DataFrame) -> DataFrame:
    """Long form of an article's scores: (id, place, label, value).

    Three fixed ones, the map's by key, then the record's flat ones whose label is not there yet.
    """
    item = lambda label, value: F.struct(label.alias("label"), F.coalesce(value, F.lit(0.0)).alias("value"))
    fixed = F.array(*(item(F.lit(label), score_value(found, c)) for label, c in FIXED_ITEMS))
    own = F.transform(F.array_sort(F.map_entries(_map("scores_json"))), lambda e: item(tx.title_case_label(e["key"]), _number(e["value"])))
    items = F.concat(fixed, own)
    if "raw_json" in found.columns:
        seen = F.transform(items, lambda i: F.lower(i["label"]))
        flat = F.transform(F.array_sort(F.map_entries(_flat(_map("raw_json")))), lambda e: item(tx.title_case_label(F.replace(e["key"], F.lit("score_"), F.lit(""))), _number(e["value"])))
        items = F.concat(items, F.filter(flat, lambda i: ~F.array_contains(seen, F.lower(i["label"]))))
    return found.select("id", F.posexplode(items).alias("place", "item")).select("id", "place", "item.label", "item.value")
