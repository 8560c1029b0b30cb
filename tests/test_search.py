"""Keywords of many profiles and the trigram index against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import keywords, portal, rules, textindex
from siftline.profile import Dimension, Profile

ROWS = "doc_id long, title string, abstract string, keywords string"


def profile(name, positive, negative=()):
    return Profile(name, positive_keywords=tuple(positive), negative_keywords=tuple(negative), scoring_dimensions=(Dimension("x", "x"),))


def some_papers(spark, n=300):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcde \n") for _ in range(rng.randrange(60))) or None
    return spark.createDataFrame([(i, text(), text(), text()) for i in range(n)], ROWS).repartition(3)


def test_profiles_score_as_alone(spark):
    papers = some_papers(spark)
    rng = random.Random(1)
    words = lambda n: ["".join(rng.choice("abcdE ") for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    # keywords within each other, twice in one list, in several profiles, blank ones
    profiles = [profile("one", [*words(30), "ab", "AB", "ab", " ", "abc"], words(5)), profile("two", ["ab", "b c"], ["ab"]), profile("none", [])]
    columns = ["doc_id", "rule_positive_score", "rule_negative_score", "rule_positive_hits", "rule_negative_hits", "rule_score"]
    got = keywords.score(papers, profiles)
    assert got.columns[:4] == papers.columns and got.count() == 900
    for p in profiles:
        mine = {r.doc_id: tuple(r) for r in got.filter(F.col("profile_name") == p.name).select(*columns).collect()}
        want = {r.doc_id: tuple(r) for r in rules.score(papers, p.positive_keywords, p.negative_keywords).select(*columns).collect()}
        assert mine == want and any(r[1] for r in want.values()) != (p.name == "none")


def test_hits_and_counts(spark):
    papers = spark.createDataFrame([(1, "Graph editing", None, ""), (2, "graph", "x", None), (None, None, None, None), (2, "graph", "x", None)], ROWS)
    profiles = [profile("a", ["graph", "Graph", "edit"], ["x"]), profile("b", ["graph e"])]
    got = sorted((r.profile, r.keyword, r.negative, r.doc_id) for r in keywords.hits(papers, profiles).collect())
    assert got == [("a", "Graph", False, 1), ("a", "Graph", False, 2), ("a", "Graph", False, 2), ("a", "edit", False, 1), ("a", "graph", False, 1), ("a", "graph", False, 2), ("a", "graph", False, 2), ("a", "x", True, 2), ("a", "x", True, 2), ("b", "graph e", False, 1)]
    assert {(r.profile, r.keyword): r.n_papers for r in keywords.counts(papers, profiles).collect()} == {("a", "Graph"): 3, ("a", "graph"): 3, ("a", "edit"): 1, ("a", "x"): 2, ("b", "graph e"): 1}
    assert keywords.hits(papers.limit(0), profiles).count() == 0


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) + (" needle é京" if i in (7, 611, 1888) else "")) for i in range(2000)]
    texts = spark.createDataFrame(rows + [(2000, None), (2001, ""), (2002, "ab"), (2003, "a\nb\nneedle"), (2004, "x" * 100_000 + "needle")], "id long, blob string")
    path = str(tmp_path_factory.mktemp("index"))
    textindex.build(texts, F.col("blob"), path, span=100, buckets=4)
    return texts, path


@pytest.mark.parametrize("q", ["needle", "needle é京", "é京", "abc", "ab", "a", "zzz", "needles", "a\nb", "xxxx", "needleneedle", " needle", "bcd e", "(?s).", "ééé"])
def test_index_finds_what_a_scan_finds(spark, indexed, q):
    texts, path = indexed
    got = textindex.texts_with(spark, path, q)
    want = texts.filter(F.col("blob").contains(q))
    assert sorted(got.collect()) == sorted(want.collect())


def test_index_reads_a_fraction(spark, indexed):
    _, path = indexed
    assert len(spark.read.parquet(f"{path}/texts").select("part").distinct().collect()) == 21
    found = textindex.candidates(spark, path, "needle é京")
    assert sorted(r.id for r in found.collect()) == [7, 611, 1888] and textindex.folders(spark, path, found) == [0, 6, 18]
    plan = textindex.texts_with(spark, path, "needle é京")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and "IN (0,6,18)" in plan
    assert textindex.candidates(spark, path, "é京 ").count() == 0


def test_index_grows(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "id long, blob string")
    textindex.build(texts.filter("id < 30"), F.col("blob"), str(tmp_path), span=10)
    textindex.build(texts.filter("id >= 30"), F.col("blob"), str(tmp_path), span=10, mode="append")
    ask = lambda q: sorted(r.id for r in textindex.texts_with(spark, str(tmp_path), q).collect())
    assert ask("number 4") == [4, *range(40, 50)] and ask("number") == list(range(50))


def test_portal_search_by_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Title {i % 7}", f"an Abstract of {i}", 2000 + i % 3, float(i % 11)) for i in range(300)], "doc_id long, title string, abstract string, year int, rank_score double")
    found = portal.articles(rows)
    textindex.build(found, portal.search_blob(found), str(tmp_path), span=50)
    for q in ("title 3", " ABSTRACT of 12", "2001", "3", "none"):
        want = portal.search(found, q=q, sort="year", limit=20).collect()
        assert portal.search(found, q=q, sort="year", limit=20, index=str(tmp_path)).collect() == want
