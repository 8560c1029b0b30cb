"""What must survive pruning, re-planning and killed tasks: ordinals and paid replies."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from siftline.profile import Dimension, Profile
from siftline.sources import ordinal
from siftline.streaming import journal, runner

PROFILE = Profile("p", scoring_dimensions=(Dimension("x", "x"),))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordinals_of_wide_rows(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 32).alias("t"))
        got = ordinal.numbered(wide, "k")
        # narrow and wide reads, and a join with itself, agree
        assert got.count() == 200_000 and got.filter("ordinal <> k").count() == 0
        assert got.agg(F.sum(F.length("t"))).first()[0] == 200_000 * 1024
        assert got.select("k", F.col("ordinal").alias("o")).join(got, "k").filter("o <> ordinal").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_ordinals_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, f"t{i:03}", i) for i in range(300)], "s int, t string, i long").repartition(6)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "9")
    try:
        got = ordinal.numbered(rows, ["s", "t", "i"], "n", descending=["s", "t"]).orderBy("n").collect()
        ties = ordinal.numbered(rows.select("s", "i"), "s")
        assert sorted(r.ordinal for r in ties.collect()) == list(range(300))
        assert [r.s for r in ties.orderBy("ordinal").collect()] == sorted((r.s for r in got), key=lambda s: -1 if s is None else s)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [r.n for r in got] == list(range(300))
    key = lambda r: (-1 if r.s is None else r.s, r.t)
    assert [key(r) for r in got] == sorted(map(key, got), reverse=True)
    assert ordinal.numbered(rows.limit(0), "i").count() == 0
    assert ordinal.numbered(got and rows.withColumn("ordinal", F.lit("clash")), "i").filter("ordinal = i").count() == 300


def papers(spark, n):
    return runner.keyed(spark.createDataFrame([(i, f"t{i}", "", "V", 2020, f"u{i}") for i in range(n)], "doc_id long, title string, abstract string, venue string, year int, url string"))


def counted(folder, fail_at=None):
    """A judge that notes each call; at the given call it takes its process with it, once."""

    def call(prompt):
        import os

        with open(f"{folder}/calls", "a") as f:
            f.write(prompt.split('"title":"')[1].split('"')[0] + "\n")
        if fail_at is not None and not os.path.exists(f"{folder}/died") and len(open(f"{folder}/calls").readlines()) >= fail_at:
            open(f"{folder}/died", "w").close()
            os._exit(1)
        return json.dumps({"score_overall_fit": 5, "scores": {"x": 1}})

    return call


def calls(folder):
    return (folder / "calls").read_text().split()


def test_a_broken_run_repeats_no_recorded_call(spark, tmp_path):
    out, bad = str(tmp_path / "o"), str(tmp_path / "f")
    todo = papers(spark, 40)
    with pytest.raises(Exception, match="Python worker"):
        runner.run_batch(todo, PROFILE, counted(tmp_path, 23), out, bad, 0, parallel=1, retry_sleep=0)
    assert len(calls(tmp_path)) == 23 and len(list((tmp_path / "f" / "_journal").glob("*/[0-9a-f]*"))) == 22
    # a smaller round takes over what it needs and leaves the rest for the next
    assert runner.run_batch(todo, PROFILE, counted(tmp_path), out, bad, 10, retry_sleep=0).added == 10
    fresh = len(calls(tmp_path)) - 23
    assert len(list((tmp_path / "f" / "_journal").glob("*/[0-9a-f]*"))) == 22 - (10 - fresh)
    assert runner.run_until(todo, PROFILE, counted(tmp_path), out, bad, sleep=lambda _: None, retry_sleep=0) == runner.OK
    # but for the call in which the process died, each paper was asked for once
    asked = calls(tmp_path)
    assert sorted(set(asked)) == sorted(f"t{i}" for i in range(40)) and len(asked) == 41 and asked.count(asked[22]) == 2
    assert spark.read.parquet(out).count() == 40 and list((tmp_path / "f" / "_journal").iterdir()) == []


RETRIED = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tests.test_durable import PROFILE, counted, papers
from siftline.streaming import runner
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
got = runner.run_batch(papers(spark, 30), PROFILE, counted({at!r}, 11), {at!r} + "/o", {at!r} + "/f", 0, parallel=2, retry_sleep=0)
print("added", got.added)
"""


def test_a_killed_task_repeats_no_recorded_call(tmp_path):
    root = str(__import__("pathlib").Path(__file__).parents[1])
    done = subprocess.run([sys.executable, "-c", RETRIED.format(root=root, at=str(tmp_path))], capture_output=True, text=True, timeout=300, cwd=root)
    assert "added 30" in done.stdout, done.stderr[-2000:]
    asked = calls(tmp_path)
    # the process that died may have taken a neighbour's call with it
    assert sorted(set(asked)) == sorted(f"t{i}" for i in range(30)) and len(asked) <= 32
    assert (tmp_path / "died").exists()


def test_failures_count_in_their_round_only(tmp_path):
    one = journal.Journal(str(tmp_path), "1").writer()
    one.record("a", {"reply": "x", "error": None})
    one.record("b", {"reply": None, "error": "boom"})
    assert one.find("b")["error"] == "boom" and one.find("c") is None
    two = journal.Journal(str(tmp_path), "2", ("1",)).writer()
    assert two.find("a")["reply"] == "x" and two.find("b") is None
    assert sorted(p.name for p in tmp_path.glob("*/*")) == ["a", "b"] and (tmp_path / "2" / "a").exists()


def test_a_round_recorded_twice_is_there_once(spark, tmp_path):
    out, bad = str(tmp_path / "o"), str(tmp_path / "f")
    from siftline.operators import judge

    def half(prompt):
        if '"t1"' in prompt:
            raise RuntimeError("quota")
        return "{}"

    asked = judge.ask(judge.prompts(papers(spark, 4), PROFILE), half, max_retries=1)
    for _ in range(2):  # as after a crash between the writes and the deletion of the answers
        asked.write.parquet(f"{bad}/_answers/7")
        runner.replay(spark, PROFILE, out, bad)
        assert spark.read.parquet(out).count() == 3
        assert [(r.title, r.failure_reason) for r in spark.read.parquet(f"{bad}/rows").collect()] == [("t1", "RuntimeError: quota")]
