"""Profiles, the judge stage, the runner, sources and sinks, portal frames."""

import json
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import batches
from siftline import profile as pf
from siftline.operators import judge, portal, ranking
from siftline.sources import jsonl, sinks
from siftline.streaming import runner

DATA = {"description": "d", "positive_keywords": ["x"], "scoring_dimensions": [{"key": "use", "description": "of use", "weight": 2}, "plain"], "unknown": 1}
PROFILE = pf.from_mapping(DATA, "stem")


def test_profile(tmp_path):
    assert (PROFILE.name, PROFILE.language, PROFILE.weights) == ("stem", "English", {"use": 2.0, "plain": 1.0})
    path = tmp_path / "mine.yaml"
    path.write_text("prefer: one\nscoring_dimensions: [a]\n")
    got = pf.load(path)
    assert (got.name, got.prefer, got.dimension_keys) == ("mine", ("one",), ("a",))
    assert "one" in got.prompt_block()
    for bad in ({}, {"scoring_dimensions": ["a", "a"]}, {"scoring_dimensions": ["overall_fit"]}):
        with pytest.raises(ValueError):
            pf.from_mapping(bad)


def reply(prompt: str) -> str:
    """A judge that fails for titles with "bad" and babbles around its answer."""
    title = json.loads(prompt.split("Paper:\n")[1].split("\n\nAnswer")[0])["title"]
    if "bad" in title:
        raise RuntimeError("quota exceeded")
    if "mute" in title:
        return "nothing to say"
    return "Well {: " + json.dumps({"is_suitable": "false", "priority": " KEEP ", "idea_core": "an\n idea", "title": "other", "score_overall_fit": "8", "score_theory_novelty": 7, "scores": {"use": 8}, "plain": 99})


def papers(spark, titles):
    rows = [(i, t, "abs", "V", 2020, f"u{i % 5}") for i, t in enumerate(titles)]
    return runner.keyed(spark.createDataFrame(rows, "doc_id long, title string, abstract string, venue string, year int, url string"))


def test_judged(spark):
    asked = judge.ask(judge.prompts(papers(spark, ["good", "bad", "mute"]), PROFILE), reply, retry_sleep=0)
    got = {r.doc_id: r for r in judge.judged(asked, PROFILE).collect()}
    assert (got[0].error, got[0].title, got[0].is_suitable, got[0].priority, got[0].idea_core) == (None, "good", True, "keep", "an idea")
    assert (got[0].score_overall_fit, got[0].score_use, got[0].score_plain, got[0].scores) == (8.0, 8.0, 10.0, {"use": 8.0, "plain": 10.0})
    assert got[0].rank_score == round(0.45 * 8 + 0.4 * (26 / 3) + 0.15 * 7, 4)
    assert "quota" in got[1].error and "no JSON object" in got[2].error
    with pytest.raises(ValueError):
        judge.ask(asked, reply, max_retries=0)


def test_prompt_fields(spark):
    df = spark.createDataFrame([("t " * 900, "", "p", 0.0, 2.5)], "title string, url string, pdf_url string, rule_score double, theory_signal_score double")
    fields = judge.prompt_paper(df.columns)
    row = df.select(*(c.alias(n) for n, c in fields.items())).first()
    assert len(row.title) == 654 and row.title.endswith(" ...") and (row.url, row.rule_score, row.venue) == ("p", 2.5, "")
    assert row.rule_positive_hits == [] == row.rule_negative_hits
    df = spark.createDataFrame([([], ["a"], ["b"])], "rule_positive_hits array<string>, theory_family_hits array<string>, rule_negative_hits array<string>")
    fields = judge.prompt_paper(df.columns)
    row = df.select(*(c.alias(n) for n, c in fields.items())).first()
    assert (row.rule_positive_hits, row.rule_negative_hits) == (["a"], ["b"])
    assert judge.BANDS in judge.prompts(df, PROFILE).first().prompt


def test_command_scorer():
    script = "import sys; t = sys.stdin.read(); print(t.upper()) if sys.argv[1] == '-' else sys.exit(3)"
    assert judge.CommandScorer(f'{sys.executable} -c "{script}"')("hi").strip() == "HI"
    quiet = "import sys; sys.stderr.write('err')"
    assert judge.CommandScorer(f'{sys.executable} -c "{quiet}"')("") == "err"
    with pytest.raises(RuntimeError):
        judge.CommandScorer(f'{sys.executable} -c "{script}" x')("hi") if False else judge.CommandScorer(f'{sys.executable} -c "import sys; sys.exit(3)"')("hi")
    with pytest.raises(ValueError):
        judge.CommandScorer(" ")("hi")


def test_run_until_resumes(spark, tmp_path):
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    todo = papers(spark, ["a", "b", "c", "bad", "d", "a again"])
    waits = []
    # five keys: u0 twice; "bad" never succeeds, so rounds end by the limit
    code = runner.run_until(todo, PROFILE, reply, out, bad, batch_size=2, max_rounds=6, sleep=waits.append, retry_sleep=0)
    done = spark.read.parquet(out)
    assert code == runner.OK and sorted(r.title for r in done.collect()) == ["a", "b", "c", "d"]
    assert 2 in waits and 3600 in waits
    assert runner.pending(todo, done).count() == 1
    again = runner.run_until(todo.filter("title <> 'bad'"), PROFILE, reply, out, bad, sleep=waits.append)
    assert again == runner.OK and spark.read.parquet(out).count() == 4
    assert spark.read.parquet(f"{bad}/rows").count() >= 1


def test_run_until_stops_on_auth_and_budget(spark, tmp_path):
    def locked(_):
        raise RuntimeError("token_revoked")

    args = {"retry_sleep": 0, "sleep": lambda _: None}
    assert runner.run_until(papers(spark, ["a"]), PROFILE, locked, str(tmp_path / "o"), str(tmp_path / "f"), **args) == runner.AUTH_FAILED
    out = str(tmp_path / "o2")
    runner.run_until(papers(spark, ["bad", "b", "c", "d"]), PROFILE, reply, out, str(tmp_path / "f2"), batch_size=4, max_new=2, max_rounds=3, **args)
    assert spark.read.parquet(out).count() == 2


def test_auth_among_many_failures_ends_the_run(spark, tmp_path):
    def mostly(prompt):
        raise RuntimeError("token_revoked" if '"t39"' in prompt else "boom")

    todo = runner.keyed(spark.createDataFrame([(i, f"t{i}", "", "V", 2020, f"u{i}") for i in range(40)], "doc_id long, title string, abstract string, venue string, year int, url string"))
    assert runner.run_until(todo, PROFILE, mostly, str(tmp_path / "o"), str(tmp_path / "f"), sleep=lambda _: None, retry_sleep=0) == runner.AUTH_FAILED


def test_paid_answers_are_replayed(spark, tmp_path):
    out, bad = str(tmp_path / "o"), str(tmp_path / "f")
    todo = papers(spark, ["a", "b", "mute"])
    judge.ask(judge.prompts(todo, PROFILE), reply, retry_sleep=0).write.parquet(f"{bad}/_answers/1")
    spark.range(1).write.parquet(f"{bad}/_answers/2")
    (tmp_path / "f" / "_answers" / "2" / "_SUCCESS").unlink()
    calls = []

    def counted(prompt):
        calls.append(prompt)
        return reply(prompt)

    assert runner.replay(spark, PROFILE, out, bad) == 2 and not list((tmp_path / "f" / "_answers").glob("[0-9]*"))
    assert runner.replay(spark, PROFILE, out, bad) == 0
    runner.run_batch(todo.filter("title <> 'mute'"), PROFILE, counted, out, bad, 0)
    assert not calls and sorted(r.title for r in spark.read.parquet(out).collect()) == ["a", "b"]
    got = runner.run_batch(todo.filter("title = 'a'"), PROFILE, reply, out, bad, 0, resume=False, model="m")
    assert got.added == 1 and spark.read.parquet(out).filter("title = 'a'").count() == 2
    assert spark.read.parquet(out).filter("idea_score_model = 'm' AND idea_score_ts IS NOT NULL").count() == 1


def test_selected(spark):
    rows = spark.createDataFrame([(3, "2020"), (1, "2021"), (2, "2020"), (0, "x")], "doc_id long, year string")
    assert [r.doc_id for r in runner.selected(rows, [2020], 1).collect()] == [2]
    assert runner.selected(rows).count() == 4


def test_stream_resumes(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    spark.createDataFrame([("a",), ("b",), ("a",)], "paper_key string").write.parquet(str(source / "1"))
    read = lambda: spark.readStream.schema("paper_key string").option("recursiveFileLookup", "true").parquet(str(source))
    runner.resume_stream(read(), out, check, lambda b: b)
    spark.createDataFrame([("b",), ("c",)], "paper_key string").write.parquet(str(source / "2"))
    runner.resume_stream(read(), out, check, lambda b: b)
    runner.resume_stream(read(), out, check, lambda b: b)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "n": null}\n\n[1]\n"x"\n{"a": "é"}\n', encoding="utf-8")
    df = jsonl.read_strict(spark, str(path))
    assert [json.loads(r.raw)["a"] for r in df.orderBy("file", "block", "id").collect()] == [1, "é"]
    assert df.select(jsonl.field("a")).count() == 2 == jsonl.count(spark, str(path))
    assert jsonl.read_strict(spark, str(tmp_path / "none")).count() == 0
    with path.open("a") as f:
        f.write('{"a": 1}abc\n')
    with pytest.raises(jsonl.MalformedLine):
        jsonl.read_strict(spark, str(path))
    good, bad = jsonl.read_lenient(spark, str(path))
    assert (good.count(), bad.count()) == (2, 1)
    with pytest.raises(FileNotFoundError):
        jsonl.read_lenient(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi", then', None, [1]), (1, "b", "x", None)], "n int, t string, u string, l array<int>")
    sinks.write_jsonl(df, str(tmp_path / "j"), ["n"], single=True)
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), ["t", "missing", "l"], ["n"])
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert text.startswith("t,missing,l\n") and '"say ""hi"", then",,[1]' in text
    assert json.loads(sinks.summary_json(df.filter("n = 1"))) == {"n": 1, "t": "b", "u": "x", "l": None}


def test_portal(spark):
    rows = spark.createDataFrame([(0, "T", None, "2020", "", "pdf", "light", 0.0, 5.5, {"a_b": 8.0}), (1, "", "abs", "x", "u", "", "keep", 3.0, 0.0, None)], "doc_id long, title string, abstract string, year string, url string, pdf_url string, light_priority string, rank_score double, final_score double, scores map<string,double>")
    found = portal.articles(rows)
    got = {r.id: r for r in found.collect()}
    assert (got[1].url, got[1].priority, got[1].rank_score, got[1].year, got[1].scores_json) == ("pdf", "light", 5.5, 2020, '{"a_b":8.0}')
    assert (got[2].url, got[2].year, got[2].rank_score, got[2].scores_json) == ("u", 0, 3.0, "{}")
    assert [r.id for r in portal.search(found, q=" ABS").collect()] == [2]
    assert [r.id for r in portal.search(found, sort="year").collect()] == [1, 2]
    assert portal.detail(found, 9).count() == 0
    assert tuple(portal.home(found).first()) == (2, 1, 4.25, 5.5)
    assert [(r.label, r.avg, r.high) for r in portal.dimension_stats(found).collect()] == [("A B", 8.0, 1)]
    assert json.loads(found.filter("id = 1").first().raw_json)["abstract"] is None
    assert [(r.place, r.label) for r in portal.score_items(found.filter("id = 1")).collect()] == [(0, "Rank score"), (1, "Overall fit"), (2, "Theory novelty"), (3, "A B")]
    with pytest.raises(ValueError):
        portal.search(found, limit=0)


def test_flat_dimensions_count_in_their_first_article_only(spark):
    rows = [(1, '{"x":2.0}', '{"score_y": 4.0, "score_overall_fit": 9, "other": 9}'), (2, "{}", '{"score_y": 10.0, "score_x": 9.0}'), (3, '{"y":6.0, "z": null}', "{}"), (4, '{"z":"bad", "x": 2}', None)]
    found = spark.createDataFrame(rows, "id long, scores_json string, raw_json string")
    got = portal.dimension_stats(found).collect()
    assert [(r.key, r.label, r.avg, r.high) for r in got] == [("y", "Y", 5.0, 0), ("x", "X", 2.0, 0), ("z", "Z", 0.0, 0)]


def test_score_items_of_a_record(spark):
    rows = [(1, None, 5.0, 6.0, '{"b_c":"7.5","a":null,"d":"bad"}', '{"rank_score": 3, "score_B_c": 1, "score_new": "2", "score_theory_novelty": 8, "score_odd": {}}')]
    found = spark.createDataFrame(rows, "id long, rank_score double, score_overall_fit double, score_theory_novelty double, scores_json string, raw_json string")
    got = [(r.label, r.value) for r in portal.score_items(found).orderBy("place").collect()]
    assert got == [("Rank score", 3.0), ("Overall fit", 5.0), ("Theory novelty", 6.0), ("A", 0.0), ("B C", 7.5), ("D", 0.0), ("New", 2.0), ("Odd", 0.0)]


def test_search_reads_the_record(spark):
    rows = spark.createDataFrame([(0, "T", 2021, "", "http://pdf", "Fam", "me"), (1, "U", 0, "http://u", None, None, None)], "doc_id long, title string, year int, url string, pdf_url string, theory_family string, authors string")
    found = portal.articles(rows)
    ask = lambda q: [r.id for r in portal.search(found, q=q).collect()]
    assert (ask("fam"), ask("2021"), ask("pdf"), ask("//u"), ask("me")) == ([1], [1], [], [2], [])


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7 % 101, f"t{i}") for i in range(101)], "k long, title string").repartition(5)
    got = portal.numbered(rows, "k").orderBy("k").collect()
    assert [r.ordinal for r in got] == list(range(101))


def test_export_and_progress(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0, None, "keep"), (1, None, 2.0, 1.0, None), (2, 1.0, 3.0, 1.0, "keep")], "doc_id long, rank_score double, score_overall_fit double, score_theory_novelty double, priority string")
    assert [(r["rank"], r.doc_id) for r in ranking.export(rows, ["doc_id"], 2).collect()] == [(1, 2), (2, 0)]
    assert ranking.export(rows, ["doc_id"], 0).count() == 0
    assert {r.priority: r.n for r in ranking.priority_counts(rows).collect()} == {"keep": 2, "UNKNOWN": 1}
    assert tuple(ranking.averages(rows).first()) == (0.667, 2.333, 0.667)
    assert ranking.last_value(rows, "score_overall_fit").first()[0] == 3.0
    assert [(r.priority, r.n) for r in ranking.top_groups(rows, ["priority"], 1).collect()] == [("keep", 2)]
    assert ranking.portal_ready(rows).filter(F.col("final_score") == 1.0).count() == 2
    with pytest.raises(ValueError):
        ranking.export(rows, ["doc_id"], -1)


def test_positions(spark):
    papers = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a")], "doc_id long, paper_key string")
    done = spark.createDataFrame([("a",), ("a",), (None,)], "paper_key string")
    rows = runner.positions(papers, done).orderBy("position").collect()
    assert [(r.doc_id, r.position, r.total, r.skipped) for r in rows] == [(1, 1, 3, False), (2, 2, 3, True), (3, 3, 3, True)]
    assert [r.skipped for r in runner.positions(papers, None).collect()] == [False] * 3
    assert runner.positions(papers.limit(0), done).collect() == []


def test_shown(spark):
    rows = spark.createDataFrame([(1, None, ""), (2, "x", "y")], "doc_id long, venue string, transferable_mechanism string")
    empty, full = portal.shown(portal.articles(rows)).orderBy("id").collect()
    assert (empty.venue, empty.year, empty.priority, empty.profile_name, empty.rank) == ("N/A", "N/A", "maybe", "profile", "0.00")
    assert (empty.abstract, empty.summary) == ("No abstract available.", "No idea summary available.")
    assert (full.venue, full.idea_core, full.summary) == ("x", "N/A", "y")


def test_checked_lines(spark):
    lines = spark.createDataFrame([("f", 0, i, raw) for i, raw in enumerate(('{"a": 1}', "[]", "null", '{"a": 1}x', "{"))], "file string, block long, id long, raw string")
    assert [r.kind for r in jsonl.checked(lines).orderBy("id").collect()] == ["object", "other", "other", "bad", "bad"]


def test_slices():
    column = pa.array(["a" * 6, None, "b" * 6, "c" * 30, "", "d"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), column], ["n", "t"])
    cut = list(batches.slices(iter([batch, batch.slice(0, 0)]), "t", 10))
    assert [x.column("n").to_pylist() for x in cut] == [[0, 1], [2], [3], [4, 5]]
    assert pa.Table.from_batches(cut).combine_chunks().equals(pa.Table.from_batches([batch]))


def test_ask_in_slices():
    # the first replies are out before the last prompts of a batch are read: no batch is Python objects as a whole
    asked = []

    class Papers:
        schema = T.StructType().add("doc_id", "long").add("prompt", "string")
        mapInArrow = staticmethod(lambda run, schema: run)

    def answer(prompt: str) -> str:
        asked.append(prompt[:1])
        return prompt[:1]

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["\u4e2d" + "x" * 200_000] * 50)], ["doc_id", "prompt"])
    out = judge.ask(Papers, answer)(iter([batch]))
    first = next(out)
    assert len(asked) == first.num_rows < 50
    rows = pa.Table.from_batches([first, *out])
    assert rows.column_names == ["doc_id", "prompt", "reply", "error"] and len(asked) == 50
    assert rows.column("reply").to_pylist() == ["\u4e2d"] * 50 and rows.column("doc_id").to_pylist() == list(range(50))


def test_checked_in_slices():
    # lines are Python objects a slice at a time, and are numbered on from slice to slice and batch to batch
    class Lines:
        mapInArrow = staticmethod(lambda run, schema: run)

    raw = [json.dumps({"n": i, "t": "x" * 200_000}) if i % 3 else "" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 50), pa.array([0] * 50), pa.array(range(50)), pa.array(raw)], ["file", "block", "id", "raw"])
    read = []
    out = list(jsonl.checked(Lines)(read.append(b.num_rows) or b for b in (batch, batch)))
    assert read == [50, 50] and len(out) > 4 and max(b.num_rows for b in out) < 25
    rows = pa.Table.from_batches(out)
    assert rows.column_names == [f.split()[0] for f in jsonl.CHECKED.split(", ")]
    assert rows.column("at").to_pylist() == list(range(100)) and rows.column("raw").to_pylist() == raw * 2
    assert rows.column("nth").to_pylist()[50] == 33 and rows.column("kind").to_pylist()[:3] == ["blank", "object", "object"]
