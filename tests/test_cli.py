"""The commands, end to end over small files."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from siftline import cli
from siftline.sources import jsonl

PROFILE = """
name: me
positive_keywords: [subspace, representation learning]
negative_keywords: [benchmark]
scoring_dimensions: [{key: use, weight: 2}, plain]
"""
PAPERS = [
    {"title": "Subspace editing", "abstract": "Representation  learning.", "venue": "V", "year": 2026, "url": "u1", "extra": {"a": [1]}},
    {"title": "A benchmark", "abstract": "", "venue": "V", "year": 2025, "url": "u2", "keywords": ["x"]},
    {"title": "Subspace again", "venue": "V", "year": "2026", "url": "u1"},
    {"title": "Subspace é", "venue": None, "year": 2026, "pdf_url": "p4"},
]
JUDGE = "import sys, json; t = sys.stdin.read(); print(json.dumps(dict(is_suitable=True, priority='keep', idea_core='i', score_overall_fit=8, score_theory_novelty=7, scores=dict(use=8, plain=2))))"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "me.yaml").write_text(PROFILE)
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(p) + "\n" for p in PAPERS), encoding="utf-8")
    return tmp_path


def lines(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


def test_filter(spark, files):
    args = ["filter", "--input", f"{files}/in.jsonl", "--profile", f"{files}/me.yaml", "--output-keep", f"{files}/keep", "--output-reject", f"{files}/reject", "--output-summary", f"{files}/s.json", "--target-total", "1"]
    assert cli.main(args, spark) == 0
    kept, rejected = lines(files / "keep"), lines(files / "reject")
    assert [(p["title"], p["rule_score"], p["extra"], p["year"]) for p in kept] == [("Subspace editing", 2.5, {"a": [1]}, 2026)]
    assert kept[0]["rule_positive_hits"] == ["subspace", "representation learning"] and kept[0]["profile_name"] == "me"
    assert sorted(p["title"] for p in rejected) == ["A benchmark", "Subspace é"] and rejected[0].get("keywords") in (["x"], None)
    assert json.loads((files / "s.json").read_text()) == {"kept": 1, "kept_by_venue_year": {"V::2026": 1}, "profile": "me", "rejected": 2}


def test_score_export_import(spark, files, capsys):
    (files / "judge.py").write_text(JUDGE)
    args = ["score", "--input", f"{files}/in.jsonl", "--profile", f"{files}/me.yaml", "--output", f"{files}/out", "--judge-cmd", f"{sys.executable} {files}/judge.py", "--years", "2026", "--retry-sleep", "0"]
    assert cli.main([*args, "--max-new-items", "1"], spark) == 0
    assert spark.read.parquet(f"{files}/out").count() == 1
    assert cli.main(args, spark) == 0
    done = spark.read.parquet(f"{files}/out")
    assert done.count() == 2 and {r.rank_score for r in done.collect()} == {round(0.45 * 8 + 0.4 * 6 + 0.15 * 7, 4)}
    assert cli.main(["autoretry", *args[1:], "--batch-size", "5"], spark) == 0 and spark.read.parquet(f"{files}/out").count() == 2
    cli.main(["export", "--input", f"{files}/out", "--output", f"{files}/csv", "--profile", f"{files}/me.yaml", "--top-k", "1"], spark)
    text = "".join(p.read_text() for p in (files / "csv").glob("*.csv"))
    assert text.startswith("rank,title,venue,year,url,pdf_url,priority,rank_score") and text.count("\n") == 2
    cli.main(["portal-ready", "--input", f"{files}/out", "--output", f"{files}/ready"], spark)
    ready = lines(files / "ready")
    assert {p["final_score"] for p in ready} == {done.first().rank_score} and json.loads(ready[0]["scores_json"]) == {"use": 8.0, "plain": 2.0}
    capsys.readouterr()
    cli.main(["progress", "--output", f"{files}/out", "--target-total", "3"], spark)
    assert capsys.readouterr().out.startswith("done = 2 / 3\npriority: {'keep': 2}")
    cli.main(["progress", "--output", f"{files}/none"], spark)
    assert capsys.readouterr().out.strip() == "done = 0"


def test_import(spark, files, capsys):
    with (files / "in.jsonl").open("a") as f:
        f.write("no json\n")
    spark.sql("DROP TABLE IF EXISTS cli_articles")
    cli.main(["import", "--input", f"{files}/in.jsonl", "--table", "cli_articles"], spark)
    got = {r.id: r for r in spark.table("cli_articles").collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[4].url == "p4" and json.loads(got[1].raw_json)["extra"] == {"a": [1]}
    cli.main(["import", "--input", f"{files}/in.jsonl", "--table", "cli_articles", "--append"], spark)
    assert sorted(r.id for r in spark.table("cli_articles").select("id").collect()) == list(range(1, 9))
    capsys.readouterr()
    cli.main(["home", "--table", "cli_articles"], spark)
    home = json.loads(capsys.readouterr().out)
    assert (home["total"], home["keep"], len(home["top"]), home["dimensions"]) == (8, 0, 8, [])
    cli.main(["articles", "--table", "cli_articles", "--q", "SUBSPACE ", "--sort", "year", "--limit", "3"], spark)
    assert [json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()] == [1, 3, 4]
    assert cli.main(["article", "--table", "cli_articles", "--id", "6"], spark) == 0
    page = json.loads(capsys.readouterr().out)
    assert (page["year"], page["authors"], [s["value"] for s in page["scores"]]) == ("2025", "N/A", ["0.00"] * 3)
    assert cli.main(["article", "--table", "cli_articles", "--id", "99"], spark) == 1
    spark.sql("DROP TABLE cli_articles")


def corpus(spark, folder, n=10_000):
    """The documents as JSON lines in several files of several splits, and judged fields beside them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(
        "doc_id", "text", (2018 + F.col("doc_id") % 8).alias("year"), F.col("source").alias("venue"), F.concat(F.lit("u"), "doc_id").alias("url"), F.concat(F.lit("t"), "doc_id").alias("title"), (F.col("doc_id") % 21 / 2.0).alias("rank_score")
    )
    docs.withColumnRenamed("text", "abstract").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.json(f"{folder}/all.jsonl")
    assert docs.count() == n


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_commands_keep_all_rows(spark, files, capsys, adaptive):
    corpus(spark, files)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        spark.sql("DROP TABLE IF EXISTS cli_all")
        cli.main(["import", "--input", f"{files}/all.jsonl", "--table", "cli_all"], spark)
        got = spark.table("cli_all").agg(F.count("id"), F.min("id"), F.max("id"), F.count_distinct("id"), F.count_if(F.col("title") == F.concat(F.lit("t"), F.col("id") - 1))).first()
        assert tuple(got) == (10_000, 1, 10_000, 10_000, 10_000)
        spark.sql("DROP TABLE cli_all")
        (files / "some.yaml").write_text("positive_keywords: [of the, tion]\nnegative_keywords: [http]\nscoring_dimensions: [use]\n")
        args = ["filter", "--input", f"{files}/all.jsonl", "--profile", f"{files}/some.yaml", "--output-keep", f"{files}/k", "--output-reject", f"{files}/r", "--output-summary", f"{files}/s.json"]
        cli.main([*args, "--target-total", "1000"], spark)
        kept, rejected = lines(files / "k"), lines(files / "r")
        assert len(kept) == 1000 and len(rejected) == 9000
        place = lambda p: (-p["rule_score"], [-ord(c) for c in p["title"]] + [1], int(p["url"][1:]))
        assert kept == sorted(kept, key=place)
        over = [p for p in rejected if p["rule_score"] >= 1.0]
        below = rejected[len(over) :]
        assert all(p["rule_score"] < 1.0 for p in below) and over == sorted(over, key=place) and place(kept[-1]) < place(over[0])
        assert [p["url"] for p in below] == sorted((p["url"] for p in below), key=lambda u: int(u[1:]))
        cli.main(["portal-ready", "--input", f"{files}/all.jsonl", "--output", f"{files}/p"], spark)
        ready = lines(files / "p")
        assert [p["url"] for p in ready] == [f"u{i}" for i in range(10_000)] and all(p["final_score"] == p["rank_score"] for p in ready)
        capsys.readouterr()
        cli.main(["progress", "--output", f"{files}/all.jsonl"], spark)
        out = capsys.readouterr().out
        assert out.startswith("done = 10000") and out.rstrip().endswith("last item: t9999")
        cli.main(["export", "--input", f"{files}/all.jsonl", "--output", f"{files}/c", "--top-k", "20000"], spark)
        assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{files}/c").count() == 10_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_records_survive(spark, files):
    """Unknown members, explicit nulls and members that give way; no Python over the written lines."""
    rows = ['{"title": "a", "odd": {"k": [null, 1.5]}, "gone": null}', '{"title": "b", "final_score": 3, "fit_reason": null, "n": null, "z": {"q": "é"}}', "{}", '{"title": NaN, "title": "c", "rank_score": NaN}']
    (files / "in.jsonl").write_text("\n".join(rows), encoding="utf-8")
    cli.main(["portal-ready", "--input", f"{files}/in.jsonl", "--output", f"{files}/p"], spark)
    got = lines(files / "p")
    assert (got[0]["odd"], got[0]["gone"], got[0]["final_score"]) == ({"k": [None, 1.5]}, None, 0.0)
    assert (got[1]["final_score"], got[1]["fit_reason"], got[1]["n"], got[1]["z"]) == (0.0, "", None, {"q": "é"}) and "gone" not in got[1]
    assert got[2]["theory_novelty"] == 0.0 and got[3]["title"] == "c"
    plan = cli._merged(cli.load(spark, f"{files}/in.jsonl"), ["rule_score"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_malformed_line_is_named(spark, files):
    good = [json.dumps({"title": f"t{i}", "text": "x" * 200}) for i in range(5000)]
    good[17] = "  "
    good[4321] = '{"title": "cut'
    (files / "in.jsonl").write_text("\n".join(good) + "\n")
    (files / "z.jsonl").write_text("[1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        with pytest.raises(jsonl.MalformedLine, match=r"in\.jsonl:4322: "):
            cli.load(spark, f"{files}/in.jsonl")
        with pytest.raises(jsonl.MalformedLine, match=r"in\.jsonl:4322: "):
            jsonl.read_strict(spark, f"{files}/*.jsonl")
        found, bad = jsonl.read_lenient(spark, f"{files}/in.jsonl")
        assert found.count() == 4998 and [(r.line, r.raw) for r in bad.collect()] == [(4322, '{"title": "cut')]
        assert found.agg(F.count_distinct("ordinal"), F.max("ordinal"), F.count_distinct("block") > 5).first()[:] == (4998, 4997, True)
        assert found.filter(F.concat(F.lit('{"title": "t'), F.col("line") - 1, F.lit('"')) != F.substring_index("raw", ",", 1)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_order_of_judging(spark, files, capsys):
    """Papers that fail first are judged later, and come later in what is read."""
    (files / "judge.py").write_text(JUDGE + f"\nimport os\nif 'A benchmark' in t and not os.path.exists('{files}/seen'): open('{files}/seen', 'w'); sys.exit(3)")
    args = ["--input", f"{files}/in.jsonl", "--profile", f"{files}/me.yaml", "--output", f"{files}/out", "--judge-cmd", f"{sys.executable} {files}/judge.py", "--retry-sleep", "0", "--max-retries", "1"]
    cli.main(["autoretry", *args, "--batch-size", "2", "--sleep-between-rounds", "0", "--sleep-on-error", "0"], spark)
    assert [r.title for r in cli.load(spark, f"{files}/out").orderBy("ordinal").collect()][-1] == "A benchmark"
    failed = spark.read.parquet(f"{files}/out.failures/rows").collect()
    assert [(r.title, r.url) for r in failed] == [("A benchmark", "u2")] and "exit 3" in failed[0].failure_reason
    capsys.readouterr()
    cli.main(["progress", "--output", f"{files}/out"], spark)
    assert capsys.readouterr().out.rstrip().endswith("last item: A benchmark")
