"""Each stage of the pipeline against brute force on its own input."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from siftline.llm import cotrain, langid, mixing, wordtok
from tests.llm.test_ops import brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows into and out of every stage, each written and read again."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixing", "packing"]
    assert all(stages[n][1].columns == COLUMNS for n in ("language", "quality", "near_duplicates", "mixing"))


def test_language(spark, stages):
    before, after = stages["language"]
    found = langid.identify(before).collect()
    assert ids(after) == Counter(r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.LANGUAGE_SCORE)
    clean = duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()
    assert sum(ids(after)[d] for (d,) in clean) >= 0.98 * len(clean)


def test_quality(spark, stages):
    before, after = stages["quality"]
    found = cotrain.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids(after) == Counter(r.doc_id for r in found if r.kept)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    want = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == Counter(d for d, (_, c) in want.items() if d == c)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, "one clean text of its own"), (7, "quite another text of the same id"), (7, "one clean text of its own")]
    rows += [(None, "a text without an id at all"), (None, "and a second one without an id"), (None, "and a second one without an id"), (None, None), (None, None), (None, "")]
    # of id 9 only the text that is no copy of id 3's stays
    rows += [(3, long), (9, long), (9, "the only clean row of this id")]
    # changed copies under one id are one document
    rows += [(11, " ".join(f"v{i}" for i in range(60))), (11, " ".join(f"v{i}" for i in range(61)))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    after = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert after.columns == COLUMNS
    got = Counter((r.doc_id, r.text) for r in after.collect())
    assert set(got.values()) == {1}
    assert set(got) - {rows[-1], rows[-2]} == set(rows[:-2]) - {(9, long)}
    assert len({rows[-1], rows[-2]} & set(got)) == 1


def test_mixing(stages):
    before, after = stages["mixing"]
    rows = before.collect()
    sizes = Counter(r.source for r in rows)
    weights = {s: n**mixing.EXPONENT for s, n in sizes.items()}
    want = Counter()
    for r in rows:
        rate = weights[r.source] * len(rows) / (sum(weights.values()) * sizes[r.source])
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, log, at = 0, -rate, math.exp(-rate)
        while at <= u:
            k += 1
            log += math.log(rate) - math.log(k)
            at += math.exp(log)
        if k:
            want[r.doc_id] = k
    assert ids(after) == want


def test_packing(stages):
    before, after = stages["packing"]
    tok = wordtok.for_path(wordtok.vocabulary("word_bpe_49k.json"))
    sizes = Counter()
    for r in before.collect():
        sizes[r.doc_id] += len(tok.encode([r.text.encode()])[0]) + 1
    got = Counter()
    filled = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert got == sizes
    total = sum(sizes.values())
    assert sorted(filled.values(), reverse=True)[:-1] == [2048] * (total // 2048) if total % 2048 else True


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"][1].count()


def test_stages_on_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, _text string"
    rows = [(1, "The end of it.", "en", "a", 14, "x", "y"), (1, "The end of it.", "en", "a", 14, "x", "y"), (2, None, None, None, None, None, None), (None, "", "en", None, 0, "x", "y"), (None, "12 34", "en", "a", 5, None, None)]
    rows += [(4, " ".join(f"w{i}" for i in range(60_000)), None, "b", 9, "x", "y"), (5, " \n\t ", "en", "a", 5, "x", "y")]
    for given, most in ((rows, 7), ([], 0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(given, schema)
            got = stage(spark, docs, SF)
            if name != "packing":
                # columns of operators' own names that clash with the table's are replaced or carried, and none is lost
                assert set(COLUMNS) <= set(got.columns)
            found = got.collect()
            if name == "language":
                assert all(r.text and any(map(str.isalpha, r.text)) for r in found)
            elif name == "near_duplicates" and given:
                assert Counter((r.doc_id, r.text) for r in found) == Counter({(r[0], r[1]): 1 for r in rows})
            elif name == "packing":
                assert sum(r.length for r in found if r.doc_id == 1) == 2 * next((r.doc_tokens for r in found if r.doc_id == 1), 0)
            assert name in ("mixing", "packing") or len(found) <= most
