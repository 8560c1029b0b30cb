"""Operators against brute force and on odd tables."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import cotrain, langid, lattice, linedist, lineclean, matroska, mixing, neardup, wordtok

PIECES = wordtok.vocabulary("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    rows = [(1, "The end of it.", "en", "a", 14), (1, "The end of it.", "en", "a", 14), (2, None, None, None, None), (None, "", "en", None, 0), (4, "x " * 30000, None, "b", 60000), (5, " \n\t ", "en", "a", 5)]
    df = frame(spark, rows)
    for name in ("score", "kept", "size", "rate", "copy", "value", "node", "tail", "_text", "u"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


# -- near duplicates ----------------------------------------------------------------------


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_components(docs):
    ids, sets = [d for d, _ in docs], sets_of([t for _, t in docs])
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[a] = b
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True))}


def check_components(spark, docs):
    want = brute_components(docs)
    got = neardup.classify(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(docs)


def test_components_of_the_documents(spark):
    docs = [(r[0], r[1]) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    check_components(spark, docs)


def test_components_of_drifting_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    passage = [words[i] for i in rng.integers(0, 3000, 60)]
    docs = []
    for family in range(4):
        base = [words[i] for i in rng.integers(0, 3000, int(rng.integers(8, 260)))]
        for _ in range(45):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 40))):
                copy[int(rng.integers(len(copy)))] = words[int(rng.integers(3000))]
            docs.append((len(docs) * 3 + 1, " ".join(copy)))
            if family % 2:
                base = copy
    for _ in range(40):
        own = [words[i] for i in rng.integers(0, 3000, int(rng.integers(0, 60)))]
        docs.append((len(docs) * 3 + 1, " ".join(own + passage)))
    docs += [(0, "one two"), (2, "One  two"), (5, ""), (8, "one two three four five"), (11, "ONE two three four\nfive")]
    check_components(spark, docs)


#: Of 6,000 texts of each size, those whose link is lost where sketches are in signed order.
NESTED = {(72, 96): [1495], (81, 108): [316, 823, 1340, 2704], (90, 120): [119, 851, 962, 2754], (96, 128): [380, 387, 420, 561]}


def test_components_of_texts_within_others(spark):
    docs = []
    for (small, large), seeds in NESTED.items():
        for seed in seeds + list(range(6)):
            rng = random.Random(f"{small}/{large}/{seed}")
            words = [f"w{rng.randrange(10**9)}" for _ in range(large + 4)]
            docs += [(len(docs), " ".join(words[: small + 4])), (len(docs) + 1, " ".join(words))]
    check_components(spark, docs)


def test_components_of_very_long_texts(spark):
    words = [f"w{i}" for i in range(120_000)]
    longer, other = words + ["end"], words[:90_000]
    far = words[:89_990]
    docs = [(1, " ".join(words)), (2, " ".join(longer)), (3, " ".join(other)), (4, " ".join(far)), (5, "x" * 1_000_000), (6, "x" * 1_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classify(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [n - 4 for n in (120_000, 120_001, 90_000, 89_990)]
    assert got == {1: (sets[0], 1), 2: (sets[1], 1), 3: (sets[2], 3), 4: (sets[3], 3), 5: (1, 5), 6: (1, 5)}


def template_pages(n, shared, own, seed=3):
    """Pages that share ``shared`` words and have as many of their own as ``own`` draws."""
    rng = random.Random(seed)
    head = " ".join(f"t{i}" for i in range(shared))
    return [(i, head + " " + " ".join(f"p{i}w{j}" for j in range(own(rng)))) for i in range(n)]


def test_components_of_template_pages(spark):
    check_components(spark, template_pages(300, 400, lambda rng: 100))
    # own parts around what a link allows, and the template alone
    docs = template_pages(260, 400, lambda rng: rng.choice((0, 20, 60, 66, 68, 90, 130, 140, 300)))
    check_components(spark, docs + [(1000 + i, t) for i, t in template_pages(120, 90, lambda rng: rng.randrange(60), 4)])


def test_template_pages_do_not_meet(spark):
    rows = [(7, i, 496, 396, i) for i in range(3000)] + [(8, i, 100, 90, i) for i in range(50)] + [(8, 99, 80, 80, 99)]
    lists = spark.createDataFrame(rows, "value long, node long, n long, most long, label long")
    assert neardup.open_pairs_by_size(lists.filter("value = 7")).count() == 0
    got = neardup.open_pairs_by_size(lists).collect()
    want = neardup.open_pairs(lists.filter("value = 8")).collect()
    assert sorted(got) == sorted(want) and len(want) == 50 * 49 / 2 + 50


def test_pairs_by_size_are_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), i, n := rng.randrange(1, 90), rng.randrange(1, n + 1), i % 9) for i in range(400)]
    lists = spark.createDataFrame(rows, "value long, node long, n long, most long, label long")
    assert sorted(neardup.open_pairs_by_size(lists).collect()) == sorted(neardup.open_pairs(lists).collect()) != []


def test_components_of_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.classify(odd(spark)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True), (4, 1, 4, True), (5, 0, 5, True)], key=str)
    assert neardup.classify(frame(spark, [])).count() == 0


# -- mixing -------------------------------------------------------------------------------


def test_poisson_counts_follow_the_weights(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'b' END AS source")
    got = {r.source: r for r in mixing.mix(docs, {"hot": 3.0, "b": 1.0, None: 0.0}, total=8000).groupBy("source").agg({"*": "count"}).collect()}
    assert set(got) == {"hot", "b"}
    assert abs(got["hot"][1] - 6000) < 5 * 6000**0.5 and abs(got["b"][1] - 2000) < 5 * 2000**0.5
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.copy, r.shuffle_key)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_poisson_inverts_the_distribution(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    for rate in (0.3, 7.0, 900.0, 2500.0):
        got = {r.doc_id: r.n_copies for r in mixing.mix(docs, total=300 * rate).select("doc_id", "n_copies").distinct().collect()}
        for d in range(300):
            u = int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:13], 16) / 2**52
            k, log, at = 0, -rate, math.exp(-rate)
            while at <= u:
                k += 1
                log += math.log(rate) - math.log(k)
                at += math.exp(log)
            assert got.get(d, 0) == k


def test_table_of_a_very_high_rate(spark):
    rated = spark.createDataFrame([("a", 1e6), ("b", 999.0), ("c", 1e-9)], "_mix_source string, _mix_rate double")
    got = {r._mix_source: r for r in mixing.poisson_tables(rated).collect()}
    low, cdf = got["a"]._mix_low, got["a"]._mix_cdf
    assert 900_000 < low < 10**6 and len(cdf) < 26_000 and cdf[-1] == pytest.approx(1, abs=1e-8)
    # the mean of the distribution, and its middle
    steps = np.diff(np.array([0.0, *cdf]))
    assert ((low + np.arange(len(cdf))) * steps).sum() == pytest.approx(1e6, rel=1e-7)
    assert got["b"]._mix_low == 0 == got["c"]._mix_low and got["c"]._mix_cdf[0] == pytest.approx(1)


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd(spark), {"a": 1.0, "b": 1.0, None: 1.0}, total=60).collect()
    assert {r.source for r in got} <= {"a", "b", None} and len(got) > 20
    assert mixing.mix(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd(spark), {"a": -1.0})


# -- language model -----------------------------------------------------------------------


def brute_word(word, pieces, logp):
    """Sum over all segmentations, by recursion."""
    into = pieces.lattice(word)

    def to(j):
        if j == 0:
            return 1.0
        return sum(to(i) * math.exp(sum(logp[b] for b in k)) for i, k in into[j])

    return math.log(to(len(into) - 1))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Z", "Cc")), min_size=1, max_size=9), min_size=1, max_size=5))
def test_forward_sums_all_segmentations(words):
    pieces = lattice.pieces_at(PIECES)
    logp = lattice.normal(np.arange(pieces.size) % 97)
    want = [brute_word(w, pieces, logp) for w in words]
    assert lattice.word_scores(words, pieces, logp) == pytest.approx(want, rel=1e-9)
    assert [lattice.word_score(w, pieces, logp) for w in words] == pytest.approx(want, rel=1e-9)
    uses, alone = np.zeros(pieces.size), np.zeros(pieces.size)
    lattice.expect(words, pieces, logp, uses)
    for w in words:
        lattice._expect_long(w, pieces, logp, alone)
    assert uses == pytest.approx(alone, rel=1e-9, abs=1e-12)
    # expected uses are the derivative of the summed log probabilities
    top = int(np.argmax(uses))
    moved = np.array(logp)
    moved[top] += 1e-6
    assert uses[top] == pytest.approx((lattice.word_scores(words, pieces, moved) - lattice.word_scores(words, pieces, logp)).sum() / 1e-6, rel=1e-3)


def test_expected_uses_of_very_long_words():
    pieces = lattice.pieces_at(PIECES)
    logp = lattice.normal(np.zeros(pieces.size))
    size = {k: len(t) for t, k in pieces.arcs.items() if k >= 0}
    for word in ("xyz" * 400, "ab" * 15, "x"):
        uses = np.zeros(pieces.size)
        lattice.expect([word], pieces, logp, uses)
        # every path spells the whole word
        assert sum(u * size[k] for k, u in enumerate(uses) if u) == pytest.approx(len(word) + 1, rel=1e-6)


TOY = lattice.Pieces({"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5, "ba": 6}, [7] * 256, np.arange(8.0))


def test_words_of_a_toy_vocabulary_sum_to_one():
    uses = np.array([3.0, 2, 1, 1, 2, 1, 1, 0])
    logp = lattice.normal(uses, 0.0 + 1e-12)
    words = [""] + [w for n in range(1, 15) for w in map("".join, __import__("itertools").product("ab", repeat=n))]
    begin, onward = uses[[0, 1, 5]].sum() / uses.sum(), uses[[2, 3, 4, 6]].sum() / uses.sum()
    total = np.exp(lattice.word_scores(words, TOY, logp)).sum()
    # longer words hold what is missing
    assert total <= begin / (1 - onward) + 1e-9 and total == pytest.approx(1, abs=0.01)


def test_a_step_sums_to_one():
    counts = Counter({"a": 5, "ab": 1, "bb": 2, "abba": 1})
    ends, n = 3, sum(counts.values())
    steps = lattice.Steps(n + ends, ends, len(counts), 2, 1)
    arcs = sum(map(steps.arc, counts.values()))
    assert steps.discount == 0.5 and arcs + steps.spelling + steps.end == pytest.approx(1)
    # spelling is spread over words that sum to one, see above; nothing known: half and half
    nothing = lattice.Steps(0, 0, 0, 0, 0)
    assert (nothing.spelling, nothing.end, nothing.arc(0)) == (0.5, 0.5, 0)


def test_scores_of_the_documents(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    words = {d: (t or "").encode().lower().split() for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    train = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(train.values()) + ends, len(train) + 1
    got = lattice.score(spark.read.parquet(f"{SF}/documents.parquet"), PIECES, lookup=50).collect()
    assert len(got) == len(docs)
    # weights fitted to counts made here, one word at a time
    pieces = lattice.pieces_at(PIECES)
    logp = pieces.seed
    for _ in range(lattice.ROUNDS):
        uses = np.zeros(pieces.size)
        for w in train:
            lattice._expect_long(w.decode(), pieces, logp, uses)
        logp = lattice.normal(uses)
    once, twice = (sum(c == k for c in train.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    for r in got:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws) + 1, sum(w in train for w in ws) + 1, n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1)), rel=1e-9)
    for r in got[:60]:
        spelled = {w: lattice.word_score(w.decode(), pieces, logp) for w in words[r.doc_id]}
        end = (ends + 1) / (n + 2)
        arc = {w: max(0, train[w] - discount) / (n + 2) for w in spelled}
        want = sum(math.log10(arc[w] + (discount * len(train) + 1) / (n + 2) * math.exp(spelled[w])) for w in words[r.doc_id]) + math.log10(end)
        assert r.score == pytest.approx(want, rel=1e-7)
        assert r.pieces_score == pytest.approx(sum(spelled[w] / math.log(10) + math.log10(1 - end) for w in words[r.doc_id]) + math.log10(end), rel=1e-7)


def test_where_words_are_looked_up(spark):
    texts = ["common common rare zebra rare common zebra rare"] * 3 + ["new common new quux new rare quux " * 5, "word " * 40, "", "y" * 3000 + " common"]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts * 8)])
    ask = lambda n: sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6), round(r.pieces_score, 6)) for r in lattice.score(docs, PIECES, lookup=n).collect())
    assert ask(1) == ask(0) == ask(1000)


def test_scores_of_odd_rows(spark):
    got = lattice.score(odd(spark), PIECES, rounds=1).collect()
    assert len(got) == 6 and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert len({(r.score, r.base_score) for r in got if r.n_tokens == 1}) == 1
    assert lattice.score(frame(spark, []), PIECES, rounds=1).count() == 0
    # no training document at all
    alone = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lattice.score(frame(spark, [(alone, "any words", None, None, None)]), PIECES).first()
    assert row.held_out and row.n_known == 0 and math.isfinite(row.score)


# -- language -----------------------------------------------------------------------------


def test_network_gradients():
    net = langid.Network(["a", "b"], units=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.frombuffer(b"abcdefgh", np.uint8).reshape(2, 4).copy()
    y, mask = np.array([0, 1]), np.array([[1, 1, 1, 0], [1, 1, 1, 1]], bool)
    _, g = net.gradients(x, y, mask)
    for name, at in (("w", (2, 1)), ("b", (0,)), ("ef", (98, 4)), ("eb", (100, 8)), ("uf", (1, 7)), ("ub", (2, 3)), ("uf", (0, 0))):
        before = net.p[name][at]
        ends = []
        for step in (1e-2, -1e-2):
            net.p[name][at] = before + step
            ends.append(net.gradients(x, y, mask)[0])
        net.p[name][at] = before
        assert g[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.03, abs=2e-5)


def test_forward_pass_by_scalar_loops():
    net = langid.Network(["a", "b", "c"], units=4, seed=3)
    data = "hé, wo".encode()
    sig = lambda v: 1 / (1 + math.exp(-v))

    def states(d, order):
        h, out = [0.0] * 4, {}
        e, u = net.p[f"e{d}"].astype(float), net.p[f"u{d}"].astype(float)
        for t in order:
            a, new = e[data[t]], []
            for i in range(4):
                back = [sum(h[k] * u[k, g * 4 + i] for k in range(4)) for g in range(3)]
                z, r = sig(a[i] + back[0]), sig(a[4 + i] + back[1])
                c = math.tanh(a[8 + i] + r * back[2])
                new.append((1 - z) * c + z * h[i])
            h = out[t] = new
        return out

    ahead, behind = states("f", range(len(data))), states("b", reversed(range(len(data))))
    got = net.probabilities(np.frombuffer(data, np.uint8).reshape(1, -1))[0]
    for t in range(len(data)):
        logits = [sum(x * net.p["w"][k, c] for k, x in enumerate(ahead[t] + behind[t])) + net.p["b"][c] for c in range(3)]
        whole = sum(map(math.exp, logits))
        assert got[t] == pytest.approx([math.exp(x) / whole for x in logits], rel=1e-4)


def test_training_sample_is_bounded(spark):
    rows = [(i, "ab " * 20, f"l{i % 3}") for i in range(30)] + [(99, "x" * (langid.SAMPLE_BYTES + 1), "l0"), (7, "ab " * 20, "l1")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(got) == 31 and max(len(t) for t, _ in got) == 60
    tied = langid.identify(frame(spark, [(i, "same text", ["en", "fr"][i % 2], None, None) for i in range(12)])).collect()
    assert len({(r.lang_pred, r.score) for r in tied}) == 1


def test_network_has_the_units_that_its_accuracy_is_stated_for():
    assert langid.Network(["a", "b"]).units == 16


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).select("doc_id", "lang", "held_out", "lang_pred", "score", "n_chars").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    alone = langid.identify(docs, carry=["doc_id"])
    assert alone.columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_languages_of_odd_rows(spark):
    got = langid.identify(odd(spark)).collect()
    assert len(got) == 6
    assert {(r.lang_pred, r.score) for r in got if not (r.text or "").strip()} == {("und", 0.0)}
    assert all(r.lang_pred == "en" for r in got if (r.text or "").strip())
    assert langid.identify(frame(spark, [])).count() == 0
    assert not langid.has_letter("1 2 ² _ -") and langid.has_letter("1ñ") and langid.has_letter("中")


# -- pages --------------------------------------------------------------------------------


def test_main_text_of_the_pages(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in linedist.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    import html
    import re

    for page, source in rows:
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page].text == "\n".join(b for b in blocks if b)
        assert got[page].n_chars == len(got[page].text)


PAGE = """<html><head><title>T</title></head><body><div class="site-header">Site</div><ul id="menu"><li><a href=x>One</a><li><a>Two</a></ul>
<div class="wrap"><h2>Big &amp; small</h2><p>%s<p>Tiny.<div class="advert"><p>Buy</div><p>Last\xa0 part<br>goes on.</div>
<form><p>Your name</p></form><div id="comments"><p>%s</div><div hidden>no</div><script>var a = "<p>x</p>";</script><footer>Foot %s</footer>"""


def test_main_text_without_article():
    long = "word " * 40
    assert linedist.main_text(PAGE % (long, long, long)) == "Big & small\n" + long.strip() + "\nTiny.\nLast part goes on."


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("plain", "plain"), ("<p>a < b &lt; c", "a < b < c"), ("<p>cut <b", "cut"), ("<!-- never closed <p>x", ""), ("<script>x", ""), ("</p></div>x</article>", "x"), ("<article><header><h1>H</h1></header><aside>no</aside>t</article>after", "H\nt")],
)
def test_main_text_of_odd_pages(page, text):
    assert linedist.main_text(page) == text


LONG = "A sentence that goes on for a good while, as the sentences of articles mostly do, and then ends."


@pytest.mark.parametrize(
    "page",
    [
        '<div class="with-sidebar"><p>{t}</p><div class="sidebar"><p>Other things</p></div></div>',
        '<form id="aspnetForm" action="/"><p>{t}</p><div class="footer">Foot</div></form>',
        '<section class="ad-free"><p>{t}</p></section><div class="ad">Buy</div>',
        '<div class="entry-header"><p>{t}</p></div><ul><li><a href="/">Home</a></li></ul>',
        '<div class="left menu"><p>{t}</p></div>',
        '<nav><p>Menu</p></nav><header><article><p>{t}</p></article></header><footer>Foot</footer>',
        '<div><div><a href="/">Home</a></div></div><div><div>Short advert</div></div><div><div><p>{t}</p></div></div><div><div>A foot</div></div>',
        '<body><div class="content"><p>{t}</p></div><div class="reader-comments"><p>{t} no</p></div>',
    ],
)
def test_main_text_whatever_its_parts_are_called(page):
    assert linedist.main_text(page.format(t=LONG)) == LONG


def test_heading_of_an_article_and_links_between_paragraphs():
    page = f'<article><div class="entry-header"><h1>Head</h1></div><p>{LONG}</p></article>'
    assert linedist.main_text(page) == f"Head\n{LONG}"
    page = f"<div><p>{LONG}</p><p><a href=x>A link alone</a></p><ul><li>one</li><li>two</li></ul><p>{LONG}</p><p>End.</p></div>"
    assert linedist.main_text(page) == f"{LONG}\nA link alone\none\ntwo\n{LONG}\nEnd."


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_pages_without_marks(data):
    """Containers without a name: the one with long blocks is the text, short ones are not."""
    short = st.lists(st.sampled_from(["Home", "About us", "Buy now", "All rights"]), min_size=1, max_size=3)
    before, after = data.draw(st.lists(short, max_size=3)), data.draw(st.lists(short, max_size=3))
    body = [LONG[: data.draw(st.integers(82, len(LONG)))].strip() + "." for _ in range(data.draw(st.integers(1, 4)))]
    tail = data.draw(st.sampled_from([[], ["End."]]))
    box = lambda blocks: "<div><div>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div></div>"
    links = "<div><ul>" + "".join(f"<li><a href=#>{x}</a></li>" for x in ("One", "Two", "Three")) + "</ul></div>"
    page = "<body>" + links + "".join(box(b) for b in before if sum(map(len, b)) < 60) + box(body + tail) + "".join(box(b) for b in after if sum(map(len, b)) < 60) + "</body>"
    assert linedist.main_text(page) == "\n".join(body + tail)


def test_long_and_hostile_pages_take_time_in_proportion():
    import time

    def took(page):
        began = time.process_time()
        linedist.main_text(page)
        return time.process_time() - began

    for page in ("<b>" * 30_000 + "</i>" * 30_000, "<b>" * 10_000 + "<p>x" * 20_000, "<div>" * 40_000 + "x", "<p class='ad'>x" * 30_000, "<a \"" * 30_000, "x" * 3_000_000):
        assert took(page) < 4


def test_runs():
    assert linedist.runs([0, 0, 0, 5, 0, 7, 0, 0, 0, 0, 2]) == [(2, 6, 7), (9, 11, 2)]
    assert linedist.runs([]) == []


def test_pages_empty_table(spark):
    assert linedist.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- line rules ---------------------------------------------------------------------------


def brute_repeats(words):
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + d for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for d in range(3)})


def test_counts_of_texts(spark):
    texts = ["a b c a b c a", "a a a a", "a b", None, "", "x # y |\nx # y |\n \nz", "a b c d a b c e b c d", "é ñ\r\né ñ"] + [" ".join("abcd"[i] for i in np.random.default_rng(s).integers(0, 4, 60)) for s in range(10)]
    got = {r.doc_id: r for r in lineclean.inspect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), brute_repeats(words))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * brute_repeats(words) > 50 * len(words)) and not (r.kept and r.base_failed)


@pytest.mark.parametrize(
    ("line", "fails"),
    [("A plain sentence, as they go.", False), ("Short title", False), ("Home | News | About | Help", True), ("a | b", True), ("WHAT!! IS!! THIS!!", True), ("Released under the MIT License.", True), ("this line of thirteen words or more goes on without any mark at all", True)]
    # dialogue, scripts without spaces, sentences ended by other marks
    + [('"Yes," he said.', False), ('"Oh?" "No."', False), ("« Oui, dit-il. »", False), ("是的，他说。", False), ("「好。」", False), ("यह एक बहुत लंबा वाक्य है जो बिना किसी लैटिन चिह्न के चलता है।", False)]
    # prose that speaks of what notices speak of, and notices
    + [("Read more about the history of the town in the chapter that follows.", False), ("The company's privacy policy was debated in parliament for several days.", False), ("The town bought a public license for the fair, as it had done in each of the last years.", False)]
    + [("Read more »", True), (" Subscribe to our newsletter", True), ("Tous droits réservés", True), ("© 2020 The Company. All rights reserved.", True), ("Home » News", True), ("to%%% ththwh$$$ oueand$$$ anthth$$$", True)],
)
def test_line_rules(spark, line, fails):
    df = spark.createDataFrame([(line,)], "line string").select(lineclean.line_fails(lineclean.F.col("line")))
    assert df.first()[0] == fails


def test_dialogue_and_scripts_without_spaces_are_kept(spark):
    said = ['"Yes," he said.', '"No," she said, "not now."', "They went on."] * 3
    talk = "\n".join(f"{x[:-2]} {w}{x[-2:]}" for x, w in zip(said * 3, "abcdefghijklmnopqrstuvwxyz", strict=False))
    chinese = "\n".join(f"他说，{i} 今天 天气 很好。" for i in range(30))
    got = {r.doc_id: r for r in lineclean.inspect(spark.createDataFrame([(1, talk), (2, chinese)], "doc_id long, text string")).collect()}
    assert got[1].n_lines_kept == got[1].n_lines == 26 and got[2].n_lines_kept == got[2].n_lines == 30
    assert got[1].kept == (not got[1].base_failed) and got[2].kept == (not got[2].base_failed)
    long = spark.createDataFrame([("é, ö. " * 200_000,), ("é, ## " * 200_000,)], "line string").select(lineclean.line_fails(lineclean.F.col("line")))
    assert [r[0] for r in long.collect()] == [False, True]


def test_cleaned_text_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "Fine words here.\nHome | News | About | Help\n\nMore words."), (2, None)], "doc_id long, text string")
    assert [r.text for r in lineclean.cleaned(df).orderBy("doc_id").collect()] == ["Fine words here.\nMore words.", None]
    assert lineclean.inspect(odd(spark)).count() == 6
    assert lineclean.inspect(frame(spark, [])).count() == 0


# -- media --------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=9000), st.integers(1, 1500))
def test_media_round_trip(samples, size):
    data = matroska.mux(samples, frame=size)
    found = matroska.parse(data)
    assert matroska.payload(data, found) == samples
    assert [c[2] for c in found.cues] == found.clusters


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=9), st.sampled_from(["xiph", "ebml", "fixed", "none"]))
def test_lacing(frames, lacing):
    if lacing == "none":
        frames = frames[:1]
    if lacing == "fixed":
        frames = [frames[0]] * len(frames)
    data = matroska.block(300, -5, frames, lacing)
    track, relative, _, ranges = matroska._frames(data, 0, len(data))
    assert (track, relative) == (300, -5) and [data[a : a + n] for a, n in ranges] == frames


def test_unknown_sizes_and_groups():
    el, u = matroska.element, matroska._uint
    group = el(matroska.BLOCK_GROUP, el(matroska.BLOCK, matroska.block(2, 7, [b"abc", b"de"], "ebml", 0)) + u(matroska.BLOCK_DURATION, 40))
    delta = el(matroska.BLOCK_GROUP, el(matroska.BLOCK, matroska.block(2, 50, [b"f"], "none", 0)) + el(matroska.REFERENCE_BLOCK, b"\xd3"))
    unknown = lambda kind: kind.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    body = el(matroska.INFO, u(matroska.TIMESTAMP_SCALE, 1_000_000)) + unknown(matroska.CLUSTER) + u(matroska.TIMESTAMP, 100) + group + delta + unknown(matroska.CLUSTER) + u(matroska.TIMESTAMP, 300) + el(matroska.SIMPLE_BLOCK, matroska.block(1, 0, [b"z"]))
    data = el(matroska.EBML, b"") + unknown(matroska.SEGMENT) + body
    got = [(t, ns, data[o : o + n], key, c) for t, ns, o, n, key, _, c in matroska.parse(data).packets]
    ms = 1_000_000
    assert got == [(2, 107 * ms, b"abc", True, 0), (2, 127 * ms, b"de", True, 0), (2, 150 * ms, b"f", False, 0), (1, 300 * ms, b"z", True, 1)]


def test_media_columns(spark):
    texts = ["Some text", None, "", "x" * 576, "é" * 100_000, "Some text"]
    got = {r.doc_id: r for r in matroska.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert got[0][1:] == got[5][1:] and got[1][1:] == got[2][1:]


def test_packet_table_of_damaged_media(spark):
    good = matroska.mux(b"a" * 2000)
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (4, bytearray(good[:200])), (5, bytearray())]
    got = matroska.packet_table(spark.createDataFrame(rows, "k long, m binary"), "k", "m").collect()
    assert sum(r.key == 1 for r in got) == 4 and {r.key for r in got if r.error} == {3, 4, 5} and not any(r.key == 2 for r in got)
    assert [struct.pack("b", 97) * r["size"] for r in got if r.key == 1] == [good[r.offset : r.offset + r["size"]] for r in got if r.key == 1]
    assert matroska.round_trip(frame(spark, [])).count() == 0 and matroska.round_trip(odd(spark)).count() == 6


# -- quality ------------------------------------------------------------------------------


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    test = labels.filter("doc_id % 4 = 1")
    got = {r.doc_id: r for r in cotrain.classify(docs, labels.filter("doc_id % 4 <> 1"), carry=["doc_id"]).collect()}
    truth = [(r.quality == 1, got[r.doc_id]) for r in test.collect()]
    assert len(got) == docs.count()
    assert sum(g == r.kept for g, r in truth) / len(truth) > 0.95
    assert sum(r.kept for g, r in truth if g) / sum(g for g, _ in truth) > 0.97


def test_co_training_costs_the_combination_nothing():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.5).astype(float)
    a = (y[:, None] * 2 - 1 + rng.standard_normal((3000, 3))).astype(np.float32)
    b = (y[:, None] * 2 - 1 + 1.5 * rng.standard_normal((3000, 20)) * np.linspace(0.7, 2, 20)).astype(np.float32)
    few = slice(0, 60)
    cal = np.arange(60) % 3 == 0
    with_pool = cotrain.cotrain([a[few], b[few]], y[few], cal, cotrain.Pool(a[60:2000], b[60:2000]))
    alone = cotrain.cotrain([a[few], b[few]], y[few], cal, cotrain.Pool(a[60:2000], b[60:2000]), rounds=0)
    right = lambda m: ((m([a[2000:], b[2000:]])[2] > 0.5) == y[2000:]).mean()
    assert right(with_pool) >= right(alone) - 0.002 and right(with_pool) > 0.95


def test_both_views_gain_by_the_exchange():
    """Forty fitted rows and two views that are independent given the class: over ten tables each
    view by itself, and the combination, get better on the mean."""
    gains = []
    for seed in range(10):
        rng = np.random.default_rng(seed)
        y = (rng.random(6000) < 0.5).astype(float)
        a = (y[:, None] * 2 - 1 + rng.standard_normal((6000, 3))).astype(np.float32)
        b = ((y[:, None] * 2 - 1) * 0.5 + rng.standard_normal((6000, 20))).astype(np.float32)
        few, cal = slice(0, 60), np.arange(60) % 3 == 0
        models = [cotrain.cotrain([a[few], b[few]], y[few], cal, cotrain.Pool(a[60:4000], b[60:4000]), rounds=r) for r in (cotrain.ROUNDS, 0)]
        assert all(v.tells for v in models[0].calibrated)
        right = [[((p > 0.5) == y[4000:]).mean() for p in m([a[4000:], b[4000:]])] for m in models]
        gains.append(np.subtract(*right))
    assert (np.mean(gains, axis=0) > 0.001).all()


def test_all_unlabelled_rows_are_in_the_pool(spark):
    rng = np.random.default_rng(4)
    words = [[f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]]
    kinds = rng.integers(0, 2, 6000)
    rows = [(i, " ".join(rng.choice(words[k], 12)), "en", f"s{k}{rng.integers(3)}", 60) for i, k in enumerate(kinds.tolist())]
    docs = frame(spark, rows).repartition(5)
    labels = spark.createDataFrame([(i, int(1 - kinds[i])) for i in range(0, 6000, 40)], "doc_id long, quality int")
    got = cotrain.fit(docs, labels)
    # the same in memory, over every row
    hashed = {r.doc_id: (r.u, r.c, r.v) for r in docs.select("doc_id", (cotrain._hash(docs.doc_id, "pool") / float(1 << 30)).alias("u"), (cotrain._hash(docs.doc_id, "sample") / float(1 << 30)).alias("v"), (cotrain._hash(docs.doc_id, "fold") % 10 < 3).alias("c")).collect()}
    views = [np.stack([cotrain.text_view(r[1].encode()) for r in rows]), np.stack([cotrain.meta_view(r[3], r[2], r[4]) for r in rows])]
    known = np.arange(6000) % 40 == 0
    u, cal, v = (np.array([hashed[i][k] for i in range(6000)]) for k in range(3))
    want = cotrain.cotrain([x[known] for x in views], 1.0 - kinds[known], cal[known], cotrain.Pool(*(x[~known] for x in views), u[~known], v[~known]))
    for a, b in zip(got.views, want.views, strict=True):
        assert a.w == pytest.approx(b.w, rel=1e-4, abs=1e-5)


def test_what_a_round_hands_over():
    """Cuts against a sort of all rows by confidence."""
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.6).astype(float)
    a = (2 * y[:, None] - 1 + rng.standard_normal((4000, 3))).astype(np.float32)
    b = (2 * y[:, None] - 1 + rng.standard_normal((4000, 4))).astype(np.float32)
    views = [cotrain.Calibrated(cotrain.Logistic().fit(x[:300], y[:300]), x[300:600], y[300:600]) for x in (a, b)]
    xs, u = [a[600:], b[600:]], rng.random(3400)
    count, *found = cotrain._split(cotrain.confident(xs, u, [], views), [1, *[cotrain.BINS] * 4])
    assert count[0] == 3400
    done = cotrain.Round(views)
    done.cuts = [[cotrain._cut(found[2 * g + k], (100, 150)[k]) for k in (0, 1)] for g in (0, 1)]
    got = cotrain._handed(xs, u, [done])
    for giver, taker in ((0, 1), (1, 0)):
        p = 1 / (1 + np.exp(-views[giver].logit(xs[giver])))
        for kind, sure, most in ((1, p, 150), (0, 1 - p, 100)):
            handed = np.flatnonzero(got[taker] == kind)
            sure_rows = np.flatnonzero(sure >= cotrain.SURE)
            # as many as wanted, or all that are sure; the surest but for ties within one bin
            assert abs(len(handed) - min(most, len(sure_rows))) <= 8
            assert set(handed) <= set(sure_rows)
            surest = np.sort(sure)[::-1][: len(handed)]
            assert np.log(sure[handed] / (1 - sure[handed])).min() >= np.log(surest / (1 - surest)).min() - 30 / cotrain.BINS - 1e-9
    # what is handed once stays as it is
    again = cotrain._handed(xs, u, [done, done])
    assert all((x[x >= 0] == z[x >= 0]).all() for x, z in zip(got, again, strict=True))


def test_quality_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = cotrain.classify(odd(spark), none).collect()
    assert len(got) == 6 and {(r.score, r.kept) for r in got} == {(0.5, True)}
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert cotrain.classify(odd(spark), labels).count() == 6
    # any number of rows of a labelled key is one row to fit on; a very long text of distinct words
    long = " ".join(f"w{i}" for i in range(150_000))
    many = frame(spark, [(i % 4, f"text {i}", "en", "s", 6) for i in range(400)] + [(5, long, None, None, None)])
    got = cotrain.classify(many, spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (5, 0)], "doc_id long, quality int"))
    assert got.count() == 401
    assert cotrain.classify(frame(spark, []), labels).count() == 0
