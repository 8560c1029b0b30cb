"""Judging a stream of papers, with the keys that are done as its state.

A key is done once its call has succeeded, and not before: papers of a done key are passed over, and one
whose call fails stays in the state with its row and comes back by a timer, after the wait for a quota or the
shorter one for other errors.  The checkpoint holds all of it, so a stopped stream goes on where it was.
Every answer is kept in a journal as it comes; a batch that is tried again finds it there.

Results and failures of a batch are written to a folder of its number, which a second try replaces.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.functions import errors
from siftline.operators import judge
from siftline.profile import Profile
from siftline.streaming import journal as jl
from siftline.streaming import runner

STATE = "done boolean, attempts int, due long, row string, prompt string"
ANSWERED = "paper_key string, row string, reply string, error string, attempt int"


@dataclass(frozen=True)
class Waits:
    """Seconds after which a failed paper is tried again, by what failed."""

    quota: float = 3600
    error: float = 600

    def of(self, error: str) -> float:
        return self.quota if errors.classify_text(error) == "quota" else self.error


def answers(papers: DataFrame, profile: Profile, scorer: judge.Scorer, waits: Waits = Waits(), journal: jl.Journal | None = None, model: str = "", abstract_chars: int = judge.ABSTRACT_CHARS) -> DataFrame:
    """A streaming frame of what was answered: of each key its failures, then one reply.

    ``papers`` is a streaming frame with ``paper_key``.  Of papers that share a key in a batch one is asked for.
    """
    asked = judge.prompts(papers, profile, abstract_chars).select("paper_key", F.to_json(F.struct(*papers.columns)).alias("row"), "prompt")

    def turn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, attempts, due, row, prompt = state.get if state.exists else (False, 0, 0, None, None)
        now = state.getCurrentProcessingTimeMs()
        for frame in frames:
            if row is None and len(frame):
                row, prompt = frame["row"].iloc[0], frame["prompt"].iloc[0]
        if done or (attempts and not state.hasTimedOut):
            # a paper that waits is not asked for early because it came again
            if not done:
                state.setTimeoutDuration(max(1, due - now))
            return
        kept = journal.writer() if journal is not None else None
        found = kept.find(name := jl.call_key(model, prompt)) if kept is not None else None
        if found is None:
            try:
                found = {"reply": scorer(prompt), "error": None}
                if kept is not None:
                    kept.record(name, found)
            except Exception as e:  # noqa: BLE001
                found = {"reply": None, "error": f"{type(e).__name__}: {e}"[-judge.FAILURE_CHARS :]}
        if found["error"] is None:
            state.update((True, attempts + 1, 0, None, None))
        else:
            wait = max(1, int(waits.of(found["error"]) * 1000))
            state.update((False, attempts + 1, now + wait, row, prompt))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame([(key[0], row, found["reply"], found["error"], attempts + 1)], columns=["paper_key", "row", "reply", "error", "attempt"])

    return asked.groupBy("paper_key").applyInPandasWithState(turn, ANSWERED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def start(papers: DataFrame, profile: Profile, scorer: judge.Scorer, output: str, failures: str, checkpoint: str, waits: Waits = Waits(), every: float = 1.0, model: str = "", on_batch: Callable[[int, int], None] = lambda number, done: None, **kwargs) -> StreamingQuery:
    """Judge ``papers`` (streaming, with ``paper_key``) until stopped: results to ``output``, failures and
    the journal to ``failures``.  ``on_batch`` is told how many papers a batch has done.  An
    authentication failure ends the stream with an error."""
    spark = papers.sparkSession
    kept = jl.begin(spark, f"{failures}/_journal", "stream")
    schema = papers.schema
    names = [f.name for f in schema if f.name != "paper_key"]

    def record(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.select(F.from_json("row", schema).alias("r"), "paper_key", "reply", "error", "attempt").select(*(f"r.{n}" for n in names), "paper_key", "reply", "error", "attempt")
            result = judge.judged(rows, profile, model)
            result.filter("error IS NULL").drop("reply", "error", "attempt").write.mode("overwrite").parquet(f"{output}/{runner.ROUND}={number}")
            lost = result.filter("error IS NOT NULL")
            lost = lost.select(*names, "paper_key", "attempt", F.col("error").alias("failure_reason"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("failure_ts"))
            lost.write.mode("overwrite").parquet(f"{failures}/rows/{runner.ROUND}={number}")
            on_batch(number, batch.filter("error IS NULL").count())
            locked = batch.filter(errors.classify(F.col("error")) == "auth").limit(1).count()
        finally:
            batch.unpersist()
        if locked:
            raise PermissionError("the judge asks for a new login")

    found = answers(papers, profile, scorer, waits, kept, model, **kwargs)
    return found.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} seconds").start()


def run(papers: DataFrame, *args, total: int, most: float, **kwargs) -> int:
    """Judge until ``total`` papers are done or ``most`` seconds have passed; how many are done."""
    before = runner._read(papers.sparkSession, args[2])
    # by batch: one that was cut short is done again under its number
    done = {r[runner.ROUND]: r.n for r in before.groupBy(runner.ROUND).agg(F.count(F.lit(1)).alias("n")).collect()} if before is not None else {}
    query, began = start(papers, *args, on_batch=done.__setitem__, **kwargs), time.monotonic()
    try:
        while query.isActive and sum(done.values()) < total and time.monotonic() - began < most:
            query.awaitTermination(0.5)
    finally:
        query.stop()
    return sum(done.values())
