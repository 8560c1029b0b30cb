"""The judged stream against rounds over the same papers."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import scores
from siftline.profile import Dimension, Profile
from siftline.streaming import judging, runner

PROFILE = Profile("p", scoring_dimensions=(Dimension("x", "x"),))
PAPER = "doc_id long, title string, abstract string, venue string, year int, url string, paper_key string"


def judge(folder):
    """Fails for every fifth paper until it has been asked twice; notes each call."""

    def call(prompt):
        title = prompt.split('"title":"')[1].split('"')[0]
        with open(f"{folder}/calls", "a") as f:
            f.write(title + "\n")
        n = int(title[1:])
        if n % 5 == 0 and open(f"{folder}/calls").read().split().count(title) < 3:
            raise RuntimeError("rate limit" if n % 2 else "boom")
        return json.dumps({"score_overall_fit": n % 10, "scores": {"x": n % 7}, "priority": "keep"})

    return call


def papers(spark, ids):
    rows = [(i, f"t{i}", "", "V", 2020, f"u{i}") for i in ids]
    return runner.keyed(spark.createDataFrame(rows, PAPER.rsplit(",", 1)[0]))


def test_stream_equals_rounds(spark, tmp_path):
    for name in ("s", "r"):
        (tmp_path / name).mkdir()
    every = papers(spark, range(23))
    # files that come in turn, with papers that come again
    for i, ids in enumerate((range(9), [3, 4, *range(9, 15)], [0, 20, 21, 22, *range(15, 20)])):
        papers(spark, ids).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = lambda: spark.readStream.schema(PAPER).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        args = (PROFILE, judge(tmp_path / "s"), str(tmp_path / "so"), str(tmp_path / "sf"), str(tmp_path / "check"))
        # stopped once on the way, and started again
        first = judging.run(source(), *args, total=10, most=90, waits=judging.Waits(2, 1), every=0.2)
        assert 10 <= first
        assert judging.run(source(), *args, total=23, most=120, waits=judging.Waits(2, 1), every=0.2) == 23
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runner.run_until(every, PROFILE, judge(tmp_path / "r"), str(tmp_path / "ro"), str(tmp_path / "rf"), batch_size=8, max_retries=1, sleep=lambda _: None) == runner.OK
    columns = ["doc_id", "paper_key", "title", "url", "rank_score", "priority", "score_x"]
    rows = lambda name: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).select(*columns).collect())
    assert rows("so") == rows("ro") and len(rows("so")) == 23
    # a success is never asked for again; a failure comes back until it succeeds
    asked = (tmp_path / "s" / "calls").read_text().split()
    assert {t: asked.count(t) for t in set(asked)} == {f"t{i}": 3 if i % 5 == 0 else 1 for i in range(23)}
    lost = spark.read.parquet(str(tmp_path / "sf" / "rows"))
    assert sorted((r.title, r.attempt) for r in lost.collect()) == sorted((f"t{i}", n) for i in range(0, 23, 5) for n in (1, 2))


def test_stream_ends_on_authentication(spark, tmp_path):
    def locked(_):
        raise RuntimeError("token_revoked")

    papers(spark, range(2)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(PAPER).parquet(str(tmp_path / "in"))
    query = judging.start(source, PROFILE, locked, str(tmp_path / "o"), str(tmp_path / "f"), str(tmp_path / "c"), every=0.2)
    with pytest.raises(Exception, match="login"):
        query.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "f" / "rows")).count() == 2


def test_rounding_is_pythons(spark):
    import random

    rng = random.Random(5)
    four = lambda: round(rng.uniform(0, 10), 4)
    xs = [0.45 * four() + 0.4 * four() + 0.15 * four() for _ in range(20_000)]
    xs += [k / 20000 for k in range(-2000, 2000)] + [k * 0.00005 for k in range(-2000, 2000)] + [rng.uniform(-1e6, 1e6) for _ in range(5000)] + [0.0, -0.0, 1e-9, -1e-9, 2.675, 1e15, 1e16, -1e300, 0.5, 1.5, 2.5, -0.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (4, 3, 0):
        assert all(r.y == round(r.x, digits) for r in df.select("x", scores.round_exact(F.col("x"), digits).alias("y")).collect())
    odd = spark.createDataFrame([(float("inf"),), (None,), (float("nan"),)], "x double").select(scores.round_exact(F.col("x"), 4).alias("y")).collect()
    assert odd[0].y == float("inf") and odd[1].y is None and odd[2].y != odd[2].y
    with pytest.raises(ValueError):
        scores.round_exact(F.col("x"), 11)
