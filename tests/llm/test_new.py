"""Hard negatives, byte-level BPE and fill-in-middle against brute force and on odd tables."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import bitslice, bytebpe, fim, langid, mixing, registry, wordtok

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int, score string, block string"


def twin(name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(registry.ORACLE_SQL[name])


def same_as_twin(spark, name, sf):
    got, want = registry.QUERIES[name](spark, sf), twin(name, sf)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall()) and rows


# -- hard negatives -----------------------------------------------------------------------


def brute_negatives(rows, every=100, k=5, n=10, low=30, high=90):
    """Scalar scores of all rows against all anchors, by Python's whole numbers."""
    fit = []
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not abs(float(np.float32(x))) < 65536 for x in v):
            continue
        fit.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(float(np.float32(x)) * 256)) for x in v]))
    anchors = {}
    for i, label, v in sorted(fit):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, mine == label) for i, mine, w in fit if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            far = [(i, -t) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s][:n]
            out += [(a, p, place, i, -s, t) for place, (i, t) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, blocks=bitslice.Blocks()):
    got = bitslice.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), blocks)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dims, labels, seed, scale=0.2, step=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, scale, (labels, dims))
    of = rng.integers(0, labels, n)
    return [(int(i) * step, [float(x) for x in (middle[o] * 0.6 + rng.normal(0, scale, dims)).astype(np.float32)], int(o), "s", "b") for i, o in enumerate(of)]


@pytest.mark.parametrize("blocks", [bitslice.Blocks(), bitslice.Blocks(37, 3, 2), bitslice.Blocks(1, 1, 1)])
def test_negatives_in_blocks(spark, blocks):
    some = vectors(350 if blocks.rows == 1 else 900, 12, 4, 3)
    want = brute_negatives(some)
    assert mined(spark, some, blocks) == want and len(want) > 50


def test_negatives_with_hot_label_and_equal_scores(spark):
    some = vectors(600, 8, 2, 5)
    # a third of the rows are alike, many scores are equal
    some = [(i, [0.25] * 8 if i % 3 == 0 else [round(x, 1) for x in v], 1 if i % 3 == 0 else label, s, b) for i, v, label, s, b in some]
    assert mined(spark, some) == brute_negatives(some)


def test_negatives_of_large_numbers(spark):
    # sums beyond 53 bits
    some = [(i, [float(np.float32(x * 250000)) for x in v], label, s, b) for i, v, label, s, b in vectors(400, 6, 3, 9)]
    assert mined(spark, some) == brute_negatives(some)


def test_negatives_of_odd_rows(spark):
    some = vectors(420, 5, 3, 7)
    some += [(None, [1.0] * 5, 1, None, None), (3, None, 1, None, None), (100, [float("nan")] * 5, 1, "", ""), (200, [None, 1.0], 1, "", ""), (7, [], 1, "", ""), (8, [float("inf")] * 5, 1, "", ""), (9, [70000.0] * 5, 0, "", "")]
    some += [(100, [0.5] * 5, 2, "", ""), (100, [0.5] * 5, 2, "", ""), (11, [0.5, 0.25], 2, "", ""), (12, [0.5] * 9, 1, "", ""), (13, [0.5] * 5, 1, "", ""), (13, [0.5] * 5, 1, "", ""), (500, [0.1] * 5, None, "", ""), (900, [-9.0] * 5, 77, "", "")]
    assert mined(spark, some) == brute_negatives(some)
    assert mined(spark, []) == [] and mined(spark, [(5, [1.0], 1, "", "")]) == [] and mined(spark, [(100, [1.0], 1, "", "")]) == []


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    numbers = rng.integers(-300, 300, (20, 7))
    planes, raw = bitslice.planes_of(numbers)
    bits = np.frombuffer(raw, np.uint8).reshape(planes, 20, -1)
    weights = [-(1 << planes - 1), *(1 << b for b in range(planes - 2, -1, -1))]
    built = sum(w * bitslice.plane(bits, p, np.arange(20), 7).astype(int) for p, w in enumerate(weights))
    assert (built == numbers).all() and planes == 10
    best = bitslice._Best(np.arange(2), np.zeros(2, int), np.full((2, 1), bitslice.NOTHING), np.full((2, 1), -bitslice.NOTHING), 3)
    a = rng.integers(-300, 300, (2, 7))
    i, j, score = bitslice.narrow(best, a, bits, 7, np.ones((2, 20), bool), np.arange(20))
    exact = a @ numbers.T
    assert (score == exact[i, j]).all() and len(i) < 40
    for x in range(2):
        assert set(np.argsort(-exact[x], kind="stable")[:3]) <= set(j[i == x])


def test_negatives_twin(spark):
    same_as_twin(spark, "op11_bit_sliced", "/root/testdata/sf0.01")


# -- language -------------------------------------------------------------------------------


def plain_states(net, x, d):
    """The recurrence as it is written in books, gates side by side."""
    h_, e, u = net.units, net.p[f"e{d}"], net.p[f"u{d}"]
    h, out = np.zeros((len(x), h_), np.float32), np.empty((x.shape[1], len(x), h_), np.float32)
    for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
        a = e[x[:, t]]
        zr = 1 / (1 + np.exp(-(h @ u[:, : 2 * h_] + a[:, : 2 * h_])))
        z, r = zr[:, :h_], zr[:, h_:]
        c = np.tanh((h @ u[:, 2 * h_ :]) * r + a[:, 2 * h_ :])
        h = out[t] = c + z * (h - c)
    return out


def test_states_and_probabilities():
    net = langid.Network(["a", "b", "c"])
    net.p["b"] += np.array([0.1, 0, -0.2], np.float32)
    x = np.random.default_rng(3).integers(0, 256, (37, 64), np.uint8)
    states = [plain_states(net, x, d) for d in "fb"]
    for d, want in zip("fb", states, strict=True):
        kept = []
        assert np.allclose(net._run(x, d), want, atol=1e-5) and np.array_equal(net._run(x, d, kept), net._run(x, d))
        # what training keeps of a step is not written over by later ones
        assert len(kept) == 64 and all(np.allclose(c + z * (h - c), want[t], atol=1e-5) for t, h, z, r, s, c in kept)
    logits = np.exp(np.concatenate(states, axis=2) @ net.p["w"] + net.p["b"])
    got = net.probabilities(x)
    assert got.shape == (37, 64, 3) and np.allclose(got, (logits / logits.sum(axis=2, keepdims=True)).transpose(1, 0, 2), atol=1e-5)
    # one language's probabilities lie together, so that sums over languages and steps go along whole rows
    assert got[:, :, 0].transpose(1, 0).flags.c_contiguous


# -- byte-level BPE -----------------------------------------------------------------------

PATH, PATTERN = wordtok.vocabulary(registry.RANKS), bytebpe.pattern()


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("peer", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return bytebpe.ByteBpe(PATH, PATTERN)


def test_ids_of_odd_texts(bpe, peer):
    texts = ["", " ", "  ", "a", " a  b", "\n\n a\t b   c\x1c d\x85 e", "x" * 5000, " " * 5000 + "a", "the<|endoftext|> end", "I'll don't 'S", "京都 123 4", "\U0001f600 \U0001f1e9\U0001f1ea", "á ​", "　  x", "�", "\0 \0"]
    rng = random.Random(4)
    texts += ["".join(rng.choice(" abct'sne.\n\t0é京1 -aAA \U0001f600") for _ in range(rng.randrange(80))) for _ in range(1500)]
    for t, (ids, _) in zip(texts, bpe.encode(texts), strict=True):
        assert ids == peer.encode_ordinary(t), t
        assert bpe.decode(ids) == t.encode() and "".join(bpe.decode_text(ids)) == t


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_of_any_text(text):
    model = bytebpe.for_vocabulary(PATH, PATTERN)
    ((ids, places),) = model.encode([text], offsets=True)
    other = tiktoken.Encoding("any", pat_str=PATTERN, mergeable_ranks=_RANKS, special_tokens={})
    assert ids == other.encode_ordinary(text) and "".join(model.decode_text(ids)) == text
    # every id's bytes are of its code points, and the ranges leave none out
    assert [a for a, _ in places] == sorted(a for a, _ in places)
    assert all(model.token_bytes[i] in text[a:b].encode() for i, (a, b) in zip(ids, places, strict=True))
    assert set().union(*(range(a, b) for a, b in places)) == set(range(len(text)))


_RANKS = bytebpe.read_ranks(PATH)


def test_split_characters(bpe):
    ids = [i for i in range(50256) if len(bpe.token_bytes[i]) == 1]
    by_byte = {bpe.token_bytes[i][0]: i for i in ids}
    assert len(by_byte) == 256
    text = "é京😀"
    assert list(bpe.decode_text([by_byte[b] for b in text.encode()])) == ["", "é", "", "", "京", "", "", "", "😀"]
    assert list(bpe.decode_text([by_byte[0xE4], by_byte[0xBA]])) == ["", "", "�"]
    with pytest.raises(KeyError):
        bpe.decode([60000])


def test_bounded_memory(peer, monkeypatch):
    for name, value in (("MAX_PIECES", 5), ("PIECE_BYTES", 4)):
        monkeypatch.setattr(bytebpe, name, value)
    model = bytebpe.ByteBpe(PATH, PATTERN)
    for t in ["a b c d e f", "wonderful a b", "", "g h i j k l m n", "a b"]:
        ((ids, _),) = model.encode([t])
        assert ids == peer.encode_ordinary(t) and len(model.known) <= 5 + 9


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ab\n\t\0\x1c\x85é京")))
def test_cuts(text):
    assert bytebpe.cut(text) == (bytebpe._CUT.split(text) if text else [])


def test_new_pieces_go_together(peer, monkeypatch):
    # thousands of new words are a few texts of the library, of long pieces nothing stays, and the most frequent ones stay
    model = bytebpe.ByteBpe(PATH, PATTERN)
    calls = []
    real = model.tokenizer

    class Counted:
        def __getattr__(self, name):
            return lambda texts, **k: calls.append(len(texts)) or getattr(real, name)(texts, **k)

    model.tokenizer = Counted()
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdeé京") for _ in range(rng.randrange(1, 9))) for _ in range(900)) for _ in range(9)] + ["", "x" * 3000 + " b" + "y" * 400 + "  c \n", " "]
    want = [peer.encode_ordinary(t) for t in texts]
    assert [ids for ids, _ in model.encode(texts)] == want
    assert sum(calls) < 50 and max(map(len, model.places)) <= bytebpe.PIECE_BYTES
    calls.clear()
    assert [ids for ids, _ in model.encode(texts)] == want and sum(calls) < 6
    monkeypatch.setattr(bytebpe, "MAX_PIECES", 600)
    for t, ids in zip(texts * 2, want * 2, strict=True):
        found, ends = model.ids([t, "a of", t])
        assert found.tolist() == ids + peer.encode_ordinary("a of") + ids and ends.tolist() == [len(ids), len(found) - len(ids), len(found)]
        assert len(model.places) <= 600 + 902
    model._thin()
    assert 0 < len(model.places) <= 200 and "a" in model.places and model.used == int(model.lens[: len(model.places)].sum())
    assert [ids for ids, _ in model.encode(texts)] == want


def odd_docs(spark):
    rows = [(1, "The end of it.", "en", "a", 14), (1, "The end of it.", "en", "a", 14), (2, None, None, None, None), (None, "", "en", None, 0), (4, "x " * 300_000, None, "b", 600_000), (5, " \n\t ", "en", "a", 5), (6, "a<P>b", "de", "a", 5), (7, "京都😀 é", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("n", "form", "output", "prefix_chars", "ids", "bytes", "starts", "_text", "_fim_units", "n_tokens"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def test_round_trip_of_odd_rows(spark, peer):
    got = sorted(bytebpe.round_trip(odd_docs(spark), PATH, PATTERN).collect(), key=str)
    want = []
    for r in odd_docs(spark).collect():
        ids = peer.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=str)
    assert bytebpe.round_trip(spark.createDataFrame([], DOCS), PATH, PATTERN).count() == 0


def test_encode_and_decode_frames(spark, peer):
    docs = odd_docs(spark)
    coded = bytebpe.encode(docs, PATH, PATTERN)
    rows = {r.doc_id: r for r in coded.collect()}
    assert rows[7].ids == peer.encode_ordinary("京都😀 é") and rows[2].ids == [] and rows[7].source is None
    assert rows[7].starts[0] == 0 and rows[7].ends[-1] == 5 and "text" not in coded.columns
    back = {r.doc_id: r for r in bytebpe.decode(coded, PATH, PATTERN).collect()}
    assert {k: r.text for k, r in back.items()} == {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(bytes(r.bytes).decode() == r.text and r.form == "clash" for r in back.values())


def test_round_trip_of_the_documents(spark, peer):
    got = {r.doc_id: r for r in registry.op12_byte_bpe(spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for i, t in docs:
        ids = peer.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


# -- fill in the middle -------------------------------------------------------------------


def arranged(i, text, rate=90, spm=20, seed="1"):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * x : 8 * x + 8], 16) for x in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(i, t, None, None, None) for i, t in enumerate(["a\r\nb", "<", "<P", "P>", "<<S", " ", "é😀" * 40, "<S", "S><M", "\n"] * 12, 100)]
    docs = docs.unionByName(spark.createDataFrame(rows, DOCS), allowMissingColumns=True)
    got = fim.transform(docs)
    assert got.columns.count("output") == 1 and "starts" in got.columns
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got), key=str) == sorted(((r.doc_id, r.text, arranged(r.doc_id, r.text)) for r in docs.collect()), key=str)
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(spark.createDataFrame([], DOCS)).count() == 0


def test_fim_of_other_units(spark):
    docs = spark.createDataFrame([(i, f"word{i} and  more, {i}.") for i in range(60)], "doc_id long, text string")
    got = fim.transform(docs, rate=100, spm=50, unit=r"(?s)\w+|\W", sentinels=("<pre>", "<suf>", "<mid>"), seed="x")
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"), ("<pre>", "<suf>", "<mid>"))).collect()
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"psm", "spm"} and {r.n for r in got} == {10}
    assert all(r.output.split("<mid>")[0].endswith(("<pre>", "<suf>", " ", ",", ".", *"0123456789", "d", "e")) for r in got)
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>", "<S>")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)


def test_fim_twin(spark):
    same_as_twin(spark, "op13_fim", "/root/testdata/sf0.01")


def test_fim_needs_no_python(spark):
    plan = registry.op13_fim(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- bounds of what is gathered -----------------------------------------------------------


def test_language_sample_is_bounded_in_bytes(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 100) AS text", "CASE WHEN id % 4 = 0 THEN 'a' ELSE 'b' END AS lang")
    got = langid.sample(rows, per_language=1000, total_bytes=100_000)
    for lang in "ab":
        assert 30_000 < sum(len(t) for t, k in got if k == lang) < 70_000
    assert len(langid.sample(rows, per_language=10)) < 50 and langid.sample(rows.limit(0)) == []


def test_large_tables_of_rates_are_shuffled(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "'t' AS text", "concat('s', id % 4) AS source")
    want = sorted(mixing.mix(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mixing.mix(docs)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and sorted(found.collect(), key=str) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
