"""The external judge: prompts, the scorer stage, and what becomes of its replies."""

from __future__ import annotations

import json
import shlex
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.batches import slices
from siftline.functions import scores as sc
from siftline.functions import text as tx
from siftline.profile import Profile
from siftline.streaming.journal import Journal, call_key

TITLE_CHARS, ABSTRACT_CHARS, NOTE_CHARS, FAILURE_CHARS = 650, 3000, 240, 2500
NOTES = ("idea_core", "transferable_mechanism", "fit_reason", "risk_or_limitation")


#: What the scores mean.
BANDS = "8 to 10: fits well, read it closely; 5 to 7: may fit, keep it for later; 0 to 4: fits little. Judge by what would carry over, not by shared words."


class Scorer(Protocol):
    """Anything that answers a prompt; it raises to report a failed call."""

    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class CommandScorer:
    """A local command that reads the prompt on its standard input."""

    command: str
    timeout: float = 900

    def __call__(self, prompt: str) -> str:
        argv = shlex.split(self.command)
        if not argv:
            raise ValueError("the scorer command is empty")
        if argv[-1] != "-":
            argv.append("-")
        done = subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=self.timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"exit {done.returncode}: {(done.stdout + done.stderr)[-FAILURE_CHARS:]}")
        return done.stdout if done.stdout.strip() else done.stderr


def prompt_paper(columns: list[str], abstract_chars: int = ABSTRACT_CHARS) -> dict[str, Column]:
    """Fields of the paper that the judge sees, by name."""

    def col(*names: str) -> Column:
        return tx.first_text(*(F.col(n).cast("string") for n in names if n in columns)) if any(n in columns for n in names) else F.lit("")

    def number(*names: str) -> Column:
        return tx.first_number(*(F.col(n).cast("double") for n in names if n in columns)) if any(n in columns for n in names) else F.lit(0.0)

    def hits(*names: str) -> Column:
        some = [F.when(F.size(n) > 0, F.col(n)) for n in names if n in columns]
        return F.coalesce(*some, F.array().cast("array<string>"))

    return {
        "title": tx.clean_text(col("title"), TITLE_CHARS),
        "abstract": tx.clean_text(col("abstract"), abstract_chars),
        "venue": col("venue"),
        "year": col("year"),
        "url": col("url", "pdf_url"),
        "rule_score": number("rule_score", "theory_signal_score"),
        "rule_positive_hits": hits("rule_positive_hits", "theory_family_hits"),
        "rule_negative_hits": hits("rule_negative_hits", "negative_hits"),
    }


def prompts(papers: DataFrame, profile: Profile, abstract_chars: int = ABSTRACT_CHARS) -> DataFrame:
    """``papers`` with ``prompt``: profile, paper as JSON and the wanted reply, from one template."""
    reply = {"is_suitable": True, "priority": "|".join(sc.PRIORITIES), **{n: "one sentence" for n in NOTES}, "score_overall_fit": 0, "score_theory_novelty": 0, "scores": dict.fromkeys(profile.dimension_keys, 0)}
    head = "Judge how far the central idea of this paper carries over to the direction below, whatever its own field.\n\n" + profile.prompt_block() + "\n\nPaper:\n"
    tail = "\n\nAnswer with one JSON object of this shape, all scores from 0 to 10:\n" + json.dumps(reply) + "\n" + BANDS
    fields = prompt_paper(papers.columns, abstract_chars)
    return papers.withColumn("prompt", F.concat(F.lit(head), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))), F.lit(tail)))


def ask(papers: DataFrame, scorer: Scorer, max_retries: int = 2, retry_sleep: float = 5.0, sleep=time.sleep, journal: Journal | None = None, model: str = "") -> DataFrame:
    """``papers`` (with ``prompt``) and the judge's ``reply`` or ``error`` for each.

    A failed call becomes a row, never an exception.  With a ``journal`` each reply is kept as it
    comes, and a task that is tried again asks only for what is not there yet.  Callers write the
    result once before they split it.

    A task holds some 2 MB of prompts as Python objects (or one prompt) and their replies, whatever
    the table's size; the paper's columns pass as Arrow batches.
    """
    if max_retries < 1:
        raise ValueError("max_retries must be at least 1")
    schema = T.StructType([*papers.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def call(prompt: str) -> dict[str, str | None]:
        error = None
        for attempt in range(max_retries):
            try:
                return {"reply": scorer(prompt), "error": None}
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"[-FAILURE_CHARS:]
                if attempt + 1 < max_retries:
                    sleep(retry_sleep)
        return {"reply": None, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = journal.writer() if journal is not None else None
        for batch in slices(batches, "prompt"):
            found = []
            for prompt in batch.column("prompt").to_pylist():
                key = call_key(model, prompt)
                answer = kept.find(key) if kept is not None else None
                if answer is None:
                    answer = call(prompt)
                    if kept is not None:
                        kept.record(key, answer)
                found.append(answer)
            new = [pa.array([x[n] for x in found], pa.string()) for n in ("reply", "error")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return papers.mapInArrow(run, schema)


def _variant(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def judged(replies: DataFrame, profile: Profile, model: str = "", exact: bool = False) -> DataFrame:
    """Replies parsed, cleaned and blended: flags, notes, scores, rank_score, or ``error``.

    ``exact``: the rank score is rounded as Python rounds, and not half up on its decimal text.

    Columns of the judge replace the paper's of the same name; no other key of a reply is read.  A
    dimension that ``scores`` lacks is looked up beside it; one that is null there is 0.
    """
    base = replies.withColumn("_v", tx.first_json_object(F.col("reply")))
    v = F.col("_v")
    number = lambda path: sc.clamp(tx.to_double(_variant(v, path, "string").try_cast("string"), None))
    has = lambda k: _variant(v, f"$.scores['{k}']", "variant").isNotNull()
    dims = {k: F.when(has(k), number(f"$.scores['{k}']")).otherwise(number(f"$['{k}']")) for k in profile.dimension_keys}
    out = base.withColumns(
        {
            "error": F.coalesce(F.col("error"), F.when(v.isNull(), F.lit("no JSON object in the reply"))),
            "is_suitable": tx.truthy_text(_json_text(v, "$.is_suitable")),
            "priority": sc.priority(_variant(v, "$.priority", "string")),
            **{n: tx.clean_text(_variant(v, f"$.{n}", "string"), NOTE_CHARS) for n in NOTES},
            "score_overall_fit": number("$.score_overall_fit"),
            "score_theory_novelty": number("$.score_theory_novelty"),
            **{f"score_{k}": c for k, c in dims.items()},
        }
    ).drop("_v")
    own = {k: F.col(f"score_{k}") for k in profile.dimension_keys}
    mean = sc.weighted_mean(own, profile.weights)
    parts = (F.col("score_overall_fit"), mean, F.col("score_theory_novelty"))
    rank = sc.rank_score(*parts)
    if exact:
        out, rank = out.withColumn("rank_score", sc.blend(*parts)), sc.round_exact(F.col("rank_score"), 4)
    return out.withColumns(
        {
            "scores": F.create_map(*(x for k, c in own.items() for x in (F.lit(k), c))),
            "rank_score": rank,
            "profile_name": F.lit(profile.name),
            "analysis_tier": F.lit("idea_score"),
            "idea_score_model": F.lit(model),
            "idea_score_ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
        }
    )


def _json_text(v: Column, path: str) -> Column:
    """A member as JSON text, so that "" and "false" differ from nothing and false."""
    return F.to_json(_variant(v, path, "variant"))
