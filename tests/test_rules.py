"""Rule filter, keys and text normalisation."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import errors, scores
from siftline.functions import text as tx
from siftline.operators import rules

POSITIVE, NEGATIVE = ["flow matching", " Subspace ", "", "editing", "representation learning"], ["benchmark", "user study only"]
PAPER = "doc_id long, title string, abstract string, keywords string, venue string, year string, url string"


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(
        [
            (0, "Subspace Editing of Representations", "Editing without retraining; representation\t learning.", None, "V", "2026", "u0"),
            (1, "A Benchmark", "Planning benchmark, no user study only.", "", "V", "2025", "u1"),
            (2, "Where models flow", "matching of motion", "partying", None, "2025.0", "u2"),
            (3, None, None, None, "W", None, "u2"),
            (4, "Subspace Editing of Representations", "Editing without retraining; representation learning.", None, "V", "2026", "u4"),
        ],
        PAPER,
    )


def test_scores_and_hits(papers):
    got = {r.doc_id: r for r in rules.score(papers, POSITIVE, NEGATIVE).collect()}
    assert (got[0].rule_positive_score, got[0].rule_negative_score, got[0].rule_score) == (3.5, 0.0, 3.5)
    assert got[0].rule_positive_hits == [" Subspace ", "editing", "representation learning"]
    assert (got[1].rule_negative_score, got[1].rule_score) == (2.5, -3.125)
    # a phrase may straddle the fields' border
    assert (got[2].rule_score, got[2].rule_positive_hits) == (1.5, ["flow matching"])
    assert (got[3].rule_score, got[3].rule_positive_hits) == (0.0, [])


def test_years(papers):
    assert [r.doc_id for r in rules.in_years(papers, [2025]).collect()] == [1]
    assert rules.in_years(papers, []).count() == 5


def test_first_wins_and_split(papers):
    scored = rules.score(papers, POSITIVE, NEGATIVE)
    unique = rules.first_wins(scored, "url", "doc_id")
    assert sorted(r.doc_id for r in unique.collect()) == [0, 1, 2, 4]
    # ties of score and title keep input order
    assert [r.doc_id for r in rules.kept(unique).collect()] == [0, 4, 2]
    assert [(r.doc_id, r.part) for r in rules.rejected(unique, target_total=2).orderBy("doc_id").collect()] == [(1, "below"), (2, "overflow")]
    assert rules.summary(unique, "p", target_total=2).first() == ("p", 2, 2)
    # a cap beyond all rows, nothing that passes, titles that are null
    assert [r.doc_id for r in rules.rejected(unique, target_total=9).collect()] == [1]
    assert sorted((r.doc_id, r.part) for r in rules.rejected(unique, min_score=99.0, target_total=1).collect()) == [(i, "below") for i in (0, 1, 2, 4)]
    nulls = scored.withColumn("title", F.when(F.col("doc_id") > 2, F.col("title")))
    assert sorted((r.doc_id, r.part) for r in rules.rejected(nulls, min_score=0.0, target_total=3).collect()) == [(1, "below"), (3, "overflow")]
    assert [r.place for r in rules.ranked(unique, 10).orderBy("place").collect()] == [1, 2, 3]
    assert {r.venue_year: r.n for r in rules.venue_years(unique).collect()} == {"V::2026": 2, "V::2025": 1, "None::2025.0": 1}


def test_text_is_worked_out_once(papers):
    for frame in (rules.kept(rules.score(papers, POSITIVE, NEGATIVE), 1.0, 2), rules.keyword_counts(papers, POSITIVE)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") == 3


def test_zero_as_identity(spark):
    row = spark.createDataFrame([("0", 0, "u")], "id string, paper_id int, url string")
    assert row.select(tx.paper_key(row.columns, F.lit("t"), F.lit("v"), F.lit(1))).first()[0] == "id::0"
    assert row.drop("id").select(tx.paper_key(["paper_id", "url"], F.lit("t"), F.lit("v"), F.lit(1))).first()[0] == "url::u"


def test_keyword_counts(papers):
    got = {r.keyword: r.n_papers for r in rules.keyword_counts(papers, ["art", "editing", "none of these"]).collect()}
    assert got == {"art": 1, "editing": 2}


def test_paper_keys(spark):
    df = spark.createDataFrame([("p", "d", "t", 2020), ("", "d", "t", 2020), (None, None, "t", 2020), (None, None, None, None)], "paper_id string, doi string, title string, year int")
    got = [r[0] for r in df.select(tx.paper_key(df.columns, F.col("title"), F.lit("v"), F.col("year"))).collect()]
    import hashlib

    assert got == ["paper_id::p", "doi::d", "sha1::" + hashlib.sha1(b"t::v::2020").hexdigest(), "sha1::" + hashlib.sha1(b"::v::").hexdigest()]


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=30), st.integers(1, 20))
def test_clean_text(spark, text, most):
    want = " ".join(__import__("re").sub(r"\s+", " ", text).split(" ")).strip(" ")
    row = spark.createDataFrame([(text,)], "t string").select(tx.clean_text(F.col("t")), tx.clean_text(F.col("t"), most)).first()
    assert row[0] == want
    assert row[1] == (want if len(want) <= most else want[:most] + " ...")


@pytest.mark.parametrize(
    ("raw", "value"),
    [("8", 8.0), ("8/10", 0.0), (None, 0.0), ("nan", 10.0), ("inf", 10.0), ("-inf", 0.0), ("1_0", 10.0), ("8d", 0.0), (" 7.25 ", 7.25), (".5", 0.5), ("1e1", 10.0)],
)
def test_clamp(spark, raw, value):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(scores.clamp(tx.to_double(F.col("x"), None))).first()[0] == value


@pytest.mark.parametrize(("raw", "value"), [(" KEEP ", "keep"), ("later", "maybe"), (None, "maybe"), ("Drop", "drop")])
def test_priority(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "x string").select(scores.priority(F.col("x"))).first()[0] == value


@pytest.mark.parametrize(("raw", "value"), [('"false"', True), ('""', False), ("0", False), (None, False), ("true", True), ("[]", False), ("0.5", True)])
def test_truthiness(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "x string").select(tx.truthy_text(F.col("x"))).first()[0] is value


@pytest.mark.parametrize(
    ("reply", "value"),
    [
        ('{"a":{"b":2}}', '{"a":{"b":2}}'),
        ('Sure { no: \n```json\n{"a":1} bye', '{"a":1}'),
        ('```json\n{"a":1}\n```', '{"a":1}'),
        ('[{"a":1},{"b":2}]', '{"a":1}'),
        ("", None),
        (None, None),
        ("no object {", None),
    ],
)
def test_first_json_object(spark, reply, value):
    got = spark.createDataFrame([(reply,)], "x string").select(F.to_json(tx.first_json_object(F.col("x")))).first()[0]
    assert got == value


def test_rank_blend(spark):
    dims = {"a": F.lit(8.0), "b": F.lit(7.0), "c": F.lit(6.0)}
    mean = scores.weighted_mean(dims, {"a": 2.0, "b": 1.2, "c": 1.0})
    row = spark.range(1).select(scores.rank_score(F.lit(8.0), mean, F.lit(7.0)), scores.weighted_mean(dims, {"a": 0.0, "b": -1.0, "c": 0.0})).first()
    assert tuple(row) == (7.5452, 0.0)


def test_error_classes(spark):
    texts = ["401 Unauthorized, quota gone", "Rate limit", "Quota exceeded", "boom", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(errors.classify(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ["auth", "quota", "quota", "other", "other"]
    assert errors.classify_text("Please LOG IN again") == "auth"
