"""Incremental judging: resume, success budget, rounds with retry policy, and a stream form."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import errors
from siftline.functions import text as tx
from siftline.operators import judge, rules
from siftline.profile import Profile
from siftline.sources import ordinal, shared
from siftline.streaming import journal as jl

OK, AUTH_FAILED = 0, 2
#: In which round a paper was judged and, of a bounded round, its place there: the order of judging.
ROUND, PLACE = "judged_round", "judged_place"


def keyed(papers: DataFrame) -> DataFrame:
    """``papers`` with ``paper_key``; one that they have stays."""
    if "paper_key" in papers.columns:
        return papers
    column = lambda n: F.col(n) if n in papers.columns else F.lit("")
    return papers.withColumn("paper_key", tx.paper_key(papers.columns, column("title"), column("venue"), column("year")))


def pending(papers: DataFrame, done: DataFrame | None, order: str = "doc_id") -> DataFrame:
    """First rows of keys that are not done: the anti-join stands before any paid call."""
    first = rules.first_wins(papers, "paper_key", order)
    return first if done is None else first.join(done.select("paper_key").distinct(), "paper_key", "left_anti")


def head(papers: DataFrame, top_k: int = 0, order: str = "doc_id") -> DataFrame:
    """The first ``top_k`` rows in input order; 0 means all."""
    if top_k > rules.GATHERED:
        return ordinal.numbered(papers, order, "_place").filter(F.col("_place") < top_k).drop("_place")
    return papers.orderBy(order).limit(top_k) if top_k > 0 else papers


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        # nothing there, or nothing committed yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


@dataclass
class Batch:
    """What a round brought; ``auth`` and ``quota``: whether any of its failures is of that class."""

    added: int
    failed: int
    auth: bool
    quota: bool


def done_keys(output: DataFrame) -> DataFrame:
    """Distinct paper keys of judged papers."""
    return keyed(output).select("paper_key").distinct()


def selected(papers: DataFrame, years: Sequence[int] = (), top_k: int = 0, order: str = "doc_id") -> DataFrame:
    """What is to be judged: rows of the given years, of these the first ``top_k``."""
    return head(rules.in_years(papers, years), top_k, order)


def positions(papers: DataFrame, done: DataFrame | None, order: str = "doc_id") -> DataFrame:
    """``papers`` (with ``paper_key``) with ``position`` from 1 in input order, ``total`` and
    ``skipped``: whether the paper is done.  All rows count, also those that are skipped."""
    found = ordinal.numbered(papers, order, "_ordinal").withColumn("position", F.col("_ordinal") + 1).drop("_ordinal")
    found = found.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))
    if done is None:
        return found.withColumn("skipped", F.lit(False))
    keys = done.select("paper_key").distinct().withColumn("_done", F.lit(True))
    return found.join(keys, "paper_key", "left").withColumn("skipped", F.col("_done").isNotNull()).drop("_done")


def _record(answers: str, spark: SparkSession, profile: Profile, output: str, failures: str, model: str, once: bool = True) -> Batch:
    """Split a round's answers into results and failures, write both, and drop the answers.

    Results and failures of a round each have a folder of their own, named by the round, which a
    second try replaces: a crash anywhere leaves neither a row twice nor one too few.  ``once``: papers
    that another round has recorded are left out.
    """
    round = answers.rstrip("/").rsplit("/", 1)[-1]
    asked = spark.read.parquet(answers)
    result = judge.judged(asked, profile, model)
    done = _read(spark, output) if once else None
    if done is not None:
        others = done.filter(F.col(ROUND) != int(round)) if ROUND in done.columns else done
        result = result.join(others.select("paper_key").distinct(), "paper_key", "left_anti").select(*result.columns)
    good, bad = result.filter("error IS NULL"), result.filter("error IS NOT NULL")
    kind = errors.classify(F.col("error"))
    counts = result.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull()), F.coalesce(F.max(kind == "auth"), F.lit(False)), F.coalesce(F.max(kind == "quota"), F.lit(False))).first()
    # the failed paper as it came, not what a judge's empty reply would make of it
    reasons = bad.select("paper_key", F.col("error").alias("failure_reason"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("failure_ts")).dropDuplicates(["paper_key"])
    lost = asked.drop("prompt", "reply", "error", "failure_reason", "failure_ts", PLACE).join(reasons, "paper_key")
    lost.write.mode("overwrite").parquet(f"{failures}/rows/{ROUND}={round}")
    good.drop("prompt", "reply", "error", ROUND).write.mode("overwrite").parquet(f"{output}/{ROUND}={round}")
    shared.delete(spark, answers)
    shared.delete(spark, f"{failures}/_journal/{round}")
    return Batch(counts[0], counts[1], bool(counts[2]), bool(counts[3]))


def replay(spark: SparkSession, profile: Profile, output: str, failures: str, model: str = "") -> int:
    """Record answers that an interrupted run has paid for but not recorded; how many were good.

    Answers of a round that was not finished stand in its journal, where the next round finds them.
    """
    fs, path = shared.hadoop(spark, f"{failures}/_answers")
    added = 0
    for found in fs.listStatus(path) if fs.exists(path) else []:
        name = found.getPath().toString()
        if shared.exists(spark, f"{name}/_SUCCESS"):
            added += _record(name, spark, profile, output, failures, model).added
        else:
            fs.delete(found.getPath(), True)
    return added


def _taken(todo: DataFrame, turn: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` rows, with their place among them."""
    if size > rules.GATHERED:
        names = [f"_turn{i}" for i in range(len(turn))]
        keyed = todo.withColumns(dict(zip(names, turn, strict=True)))
        return ordinal.numbered(keyed, names, PLACE).filter(F.col(PLACE) < size).drop(*names)
    return todo.orderBy(*turn).limit(size).withColumn(PLACE, F.row_number().over(Window.orderBy(*turn)).cast("long") - 1)


def run_batch(papers: DataFrame, profile: Profile, scorer: judge.Scorer, output: str, failures: str, size: int, order: str = "doc_id", parallel: int = 4, resume: bool = True, model: str = "", abstract_chars: int = judge.ABSTRACT_CHARS, **ask) -> Batch:
    """Judge the next ``size`` pending papers and add results and failures.

    Each reply is kept in the round's journal as it comes.  The answers are written once to the
    failures' neighbour folder before they are split, so that two sinks do not make two calls.
    Without ``resume`` done papers are judged again.
    """
    spark = papers.sparkSession
    replay(spark, profile, output, failures, model)
    todo = pending(papers, _read(spark, output) if resume else None, order)
    if size > 0:
        # papers that failed before come after those that have not been tried
        lost = _read(spark, f"{failures}/rows")
        turn = [F.col(order)]
        if lost is not None:
            todo = todo.join(lost.groupBy("paper_key").agg(F.count(F.lit(1)).alias("_failures")), "paper_key", "left")
            turn = [F.coalesce("_failures", F.lit(0)), *turn]
        todo = _taken(todo, turn, size).drop("_failures")
    round = str(time.time_ns())
    kept = jl.begin(spark, f"{failures}/_journal", round)
    prompts = judge.prompts(todo, profile, abstract_chars).repartition(parallel)
    answers = f"{failures}/_answers/{round}"
    judge.ask(prompts, scorer, journal=kept, model=model, **ask).write.parquet(answers)
    got = _record(answers, spark, profile, output, failures, model, once=resume)
    jl.tidy(spark, kept)
    return got


def run_until(
    papers: DataFrame,
    profile: Profile,
    scorer: judge.Scorer,
    output: str,
    failures: str,
    batch_size: int = 64,
    max_new: int = 0,
    max_rounds: int = 0,
    sleep_between: float = 2,
    sleep_on_quota: float = 3600,
    sleep_on_error: float = 600,
    sleep: Callable[[float], None] = time.sleep,
    **kwargs,
) -> int:
    """Rounds until all distinct papers are judged, or ``max_new`` successes or ``max_rounds``.

    A failure does not use up ``max_new``.  When a round adds nothing: authentication ends the
    run with code 2, a quota is waited for long, anything else shorter.
    """
    spark = papers.sparkSession
    replay(spark, profile, output, failures, kwargs.get("model", ""))
    target = papers.select("paper_key").distinct().count()
    done = _read(spark, output)
    # of the papers that are wanted: others in the output do not count
    have = papers.select("paper_key").distinct().join(done.select("paper_key").distinct(), "paper_key", "left_semi").count() if done is not None else 0
    added = rounds = 0
    while have < target and (not max_new or added < max_new) and (not max_rounds or rounds < max_rounds):
        size = min(batch_size, max_new - added) if max_new else batch_size
        got = run_batch(papers, profile, scorer, output, failures, size, **kwargs)
        rounds += 1
        added += got.added
        have += got.added
        if got.added:
            sleep(sleep_between)
            continue
        if got.auth:
            return AUTH_FAILED
        sleep(sleep_on_quota if got.quota else sleep_on_error)
    return OK


def resume_stream(source: DataFrame, output: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame]) -> None:
    """A streaming frame with ``paper_key``, whose new keys pass through ``keep`` to ``output``.

    State holds the keys; the checkpoint makes a second run add nothing.
    """

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own rows
        keep(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = source.dropDuplicates(["paper_key"]).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
