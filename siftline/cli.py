"""Commands over JSON lines and Parquet: ``python -m siftline COMMAND ...``.

Input is a ``.jsonl``/``.json`` path or a Parquet folder.  JSON lines keep members that no command
knows.  Results of the judge are a Parquet folder, to which rounds append.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import profile as pf
from siftline.functions import text as tx
from siftline.functions.overlay import overlaid
from siftline.operators import judge, portal, ranking, rules
from siftline.sources import jsonl, ordinal, shared, sinks
from siftline.sources.articletable import ArticleTable
from siftline.streaming import runner

#: Members that become columns, as text and as numbers.
TEXTS = sorted({*tx.KEY_FIELDS, *(s for names in portal.TEXTS.values() for s in names), "keywords", "theory_bucket", "theory_family", "year"})
NUMBERS = sorted({*(s for names in portal.SCORES.values() for s in names), "rule_score", "theory_signal_score"})
JUDGED = (*judge.NOTES, "priority", "profile_name", *ranking.SORT)
ORDER = "ordinal"
#: Malformed lines that a lenient reading names; all are counted.
SHOWN = 20


def _columns(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    member = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
    text = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.to_json(F.when(~F.is_variant_null(member(n)), member(n))))
    found = lines.select(
        ORDER,
        "raw",
        *(text(n).alias(n) for n in TEXTS),
        *(tx.to_double(F.try_variant_get(v, f"$.{n}", "string"), None).alias(n) for n in NUMBERS),
        F.from_json(F.to_json(F.try_variant_get(v, "$.scores", "variant")), "map<string,double>").alias("scores"),
        # in a digest a null member reads otherwise than a missing one
        *(F.when(F.is_variant_null(member(n)), "None").otherwise(text(n)).alias(f"_digest_{n}") for n in ("title", "venue", "year")),
    )
    digest = [f"_digest_{n}" for n in ("title", "venue", "year")]
    return found.withColumn("paper_key", tx.paper_key(found.columns, *(F.col(n) for n in digest))).drop(*digest)


def load(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Records with a dense ``ordinal`` in input order; of judged papers, the order of judging."""
    if path.endswith((".jsonl", ".json")):
        if lenient:
            lines, bad = jsonl.read_lenient(spark, path)
            for r in bad.orderBy("file", "line").limit(SHOWN).collect():
                print(f"{r.file}:{r.line}: {r.bad}", file=sys.stderr)
            if skipped := bad.count():
                print(f"{skipped} malformed lines skipped", file=sys.stderr)
        else:
            lines = jsonl.read_strict(spark, path)
        return _columns(lines)
    found = spark.read.parquet(path)
    if runner.ROUND in found.columns:
        # judged papers carry their round, their place in it and their place in the input
        found = found.withColumnRenamed(ORDER, "_of")
        order = [c for c in (runner.ROUND, runner.PLACE, "_of", "paper_key") if c in found.columns]
        return ordinal.numbered(found, order, ORDER).drop("_of")
    if ORDER in found.columns:
        return found
    return ordinal.numbered(runner.keyed(found), "paper_key")


def _merged(rows: DataFrame, fields: Sequence[str], order: Sequence[str] = (ORDER,)) -> DataFrame:
    """``value``: each record with ``fields`` over its own members, as JSON text."""
    if "raw" in rows.columns:
        value = overlaid(F.col("raw"), fields)
    else:
        own = [c for c in rows.columns if c not in (ORDER, *order) and c not in fields]
        record = F.to_json(F.struct(*own)) if own else F.lit("{}")
        value = overlaid(record, fields)
    return rows.select(*order, value.alias("value"))


def _write(rows: DataFrame, path: str, order: Sequence[str] = (ORDER,)) -> None:
    """Lines in the rows' order, in as many files as the sort has ranges."""
    rows.orderBy(*order).select("value").write.mode("overwrite").text(path)


def filter_papers(spark: SparkSession, a: argparse.Namespace) -> int:
    me = pf.load(a.profile)
    found = rules.in_years(load(spark, a.input), a.years)
    first = rules.first_wins(runner.keyed(found), "paper_key", ORDER)
    scored = shared.written(rules.score(first, me.positive_keywords, me.negative_keywords).withColumn("profile_name", F.lit(me.name)), "scored")
    fields = ("rule_score", "rule_positive_score", "rule_negative_score", "rule_positive_hits", "rule_negative_hits", "profile_name")
    passed = rules.placed(scored, a.min_score, order=ORDER)
    most = a.target_total if a.target_total > 0 else None
    kept = passed if most is None else passed.filter(F.col("place") < most)
    _write(_merged(kept, fields, ["place"]), a.output_keep, ["place"])
    # what the cap leaves over comes in keep order before what is below the threshold
    below = scored.filter(F.col("rule_score") < a.min_score).select("*", F.lit(1).alias("part"), F.col(ORDER).alias("place"))
    over = passed.filter(F.col("place") >= most if most is not None else F.lit(False)).withColumn("part", F.lit(0))
    _write(_merged(over.unionByName(below), fields, ["part", "place"]), a.output_reject, ["part", "place"])
    row = rules.summary(scored, me.name, a.min_score, a.target_total).first().asDict()
    row["kept_by_venue_year"] = {r.venue_year: r.n for r in rules.venue_years(kept).collect()}
    text = json.dumps(row, ensure_ascii=False, indent=2)
    Path(a.output_summary).write_text(text, encoding="utf-8")
    print(text)
    return 0


def _judging(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, dict]:
    found = runner.keyed(runner.selected(load(spark, a.input), a.years, a.top_k, ORDER))
    ask = {"max_retries": a.max_retries, "retry_sleep": a.retry_sleep, "model": a.judge_cmd, "abstract_chars": a.abstract_max_chars, "order": ORDER}
    return found, {"profile": pf.load(a.profile), "scorer": judge.CommandScorer(a.judge_cmd, a.timeout), "output": a.output, "failures": a.failures_output or f"{a.output}.failures", **ask}


def score(spark: SparkSession, a: argparse.Namespace) -> int:
    found, how = _judging(spark, a)
    if a.no_resume:
        runner.run_batch(found, size=a.max_new_items, resume=False, **how)
    else:
        # every pending paper once; a failure does not use up the budget
        added, left = 0, runner.pending(found, runner._read(spark, a.output), ORDER).count()
        while left and (not a.max_new_items or added < a.max_new_items):
            size = min(left, a.max_new_items - added) if a.max_new_items else left
            added += runner.run_batch(found, size=size, **how).added
            left -= size
    return 0


def autoretry(spark: SparkSession, a: argparse.Namespace) -> int:
    found, how = _judging(spark, a)
    return runner.run_until(found, batch_size=a.batch_size, max_rounds=a.max_rounds, sleep_between=a.sleep_between_rounds, sleep_on_quota=a.sleep_on_quota, sleep_on_error=a.sleep_on_error, **how)


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    found = load(spark, a.input)
    dims = [f"score_{k}" for k in pf.load(a.profile).dimension_keys] if a.profile else [c for c in found.columns if c.startswith("score_") and c not in portal.GLOBAL]
    fields = ["rank", "title", "venue", "year", "url", "pdf_url", "priority", *ranking.SORT, *dims, *judge.NOTES]
    if "raw" in found.columns:
        found = found.withColumns({d: tx.to_double(F.get_json_object("raw", f"$.{d}"), None) for d in dims})
    top = ranking.export(found, found.columns, a.top_k, [s for s in a.sort_by if s in found.columns], ORDER)
    sinks.write_csv(top.coalesce(1), a.output, fields, ["rank"])
    print(a.output)
    return 0


def portal_ready(spark: SparkSession, a: argparse.Namespace) -> int:
    found = load(spark, a.input)
    ready = ranking.portal_ready(found)
    new = [c for c in ranking.PORTAL if c in ready.columns]
    # of judged papers, what the judge gave stands beside the record as it came
    judged = [] if a.input.endswith((".jsonl", ".json")) else [c for c in ready.columns if c in JUDGED or c not in (*TEXTS, *NUMBERS, "raw", ORDER)]
    fields = list(dict.fromkeys([*judged, *new]))
    _write(_merged(ready, fields), a.output)
    print(json.dumps({"input": a.input, "output": a.output, "rows": ready.count()}, indent=2))
    return 0


def progress(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        print("\n".join(ranking.report(load(spark, a.output), a.target_total, ORDER)))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print("done = 0" + (f" / {a.target_total}" if a.target_total else ""))
    return 0


def import_portal(spark: SparkSession, a: argparse.Namespace) -> int:
    """Into a catalog table or, with ``--path``, a versioned table below a folder."""
    found = portal.articles(load(spark, a.input, lenient=True), ORDER)
    if a.path:
        n, where = ArticleTable(spark, a.path).add(found, replace=not a.append), a.path
    else:
        n, where = sinks.import_articles(found, a.table, replace=not a.append), a.table
    print(json.dumps({"input": a.input, "table": where, "rows": n}, indent=2))
    return 0


def _rows(found: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in found.collect()]


def portal_home(spark: SparkSession, a: argparse.Namespace) -> int:
    """Figures, strongest dimensions and top papers, as JSON."""
    if a.path:
        table = ArticleTable(spark, a.path)
        home, dimensions, top = table.home(), table.dimension_stats(), table.top_papers()
    else:
        found = spark.table(a.table)
        home, dimensions, top = portal.home(found), portal.dimension_stats(found), portal.top_papers(found)
    page = home.first().asDict() | {"dimensions": _rows(dimensions), "top": _rows(portal.shown(top))}
    print(json.dumps(page, ensure_ascii=False, indent=2))
    return 0


def portal_articles(spark: SparkSession, a: argparse.Namespace) -> int:
    """The found articles in order, a JSON line each; a page has 1,000 at most."""
    if a.path:
        found = ArticleTable(spark, a.path).page(a.q, a.priority, a.sort, a.limit)
    else:
        found = portal.search(spark.table(a.table), a.q, a.priority, a.sort, a.limit)
    for row in _rows(portal.shown(found)):
        print(json.dumps(row, ensure_ascii=False))
    return 0


def portal_article(spark: SparkSession, a: argparse.Namespace) -> int:
    """One article with all its scores, as JSON; code 1 where there is none."""
    found = ArticleTable(spark, a.path).detail(int(a.id)) if a.path else portal.detail(spark.table(a.table), int(a.id))
    page = portal.shown(found).first()
    if page is None:
        print(f"no article {a.id}", file=sys.stderr)
        return 1
    items = portal.score_items(found).orderBy("place").select("label", F.format_string("%.2f", "value").alias("value"))
    print(json.dumps(page.asDict() | {"scores": _rows(items)}, ensure_ascii=False, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siftline", description="Screen and rank papers against an interest profile.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, *needed: str, **options) -> None:
        p = commands.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, default in options.items():
            flag = f"--{n.replace('_', '-')}"
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                p.add_argument(flag, nargs="*", type=int if n == "years" else str, default=default)
            else:
                p.add_argument(flag, type=type(default), default=default)
        p.set_defaults(run=run)

    judging = {"failures_output": "", "years": [], "top_k": 0, "judge_cmd": "", "timeout": 900, "max_retries": 2, "retry_sleep": 5, "abstract_max_chars": judge.ABSTRACT_CHARS}
    command("filter", filter_papers, "input", "profile", "output-keep", "output-reject", "output-summary", years=[], target_total=0, min_score=1.0)
    command("score", score, "input", "profile", "output", **judging, no_resume=False, max_new_items=0)
    command("autoretry", autoretry, "input", "profile", "output", **judging, batch_size=1, sleep_between_rounds=2, sleep_on_quota=3600, sleep_on_error=600, max_rounds=0)
    command("export", export, "input", "output", profile="", top_k=100, sort_by=list(ranking.SORT))
    command("portal-ready", portal_ready, "input", "output")
    command("progress", progress, "output", target_total=0)
    command("import", import_portal, "input", table="articles", path="", append=False)
    command("home", portal_home, table="articles", path="")
    command("articles", portal_articles, table="articles", path="", q="", priority="", sort="rank_score", limit=100)
    command("article", portal_article, "id", table="articles", path="")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        return args.run(spark, args)
    finally:
        shared.sweep(spark)
