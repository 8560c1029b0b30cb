"""Packing and token files against brute force."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import dac, packing, wordtok

PATH = wordtok.vocabulary("word_bpe_49k.json")
TEXTS = ["The end.", "", None, "It's 12 o'clock: çA va?\n\nA  b", "İstanbul ΑΣ 中文 ² ½ x×y", "a<|endoftext|>b <|startoftext|>", "w " * 5000, "The end."]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string")


def brute(texts, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_equal_whole_texts(texts):
    ids, sizes = wordtok.for_path(PATH).encode([t.encode() for t in texts], 7)
    want = brute(texts, 7)
    assert list(sizes) == [len(w) for w in want]
    assert list(ids) == [i for w in want for i in w]


def test_full_cache_keeps_what_came_back():
    tok = wordtok.WordTokenizer(PATH, max_words=30)
    words = [f"word{i}" for i in range(100)]
    for i in range(100):
        text = " ".join([words[i], words[3], words[i // 2], "çA", words[7]])
        assert list(tok.encode([text.encode()])[0]) == brute([text], 0)[0][:-1]
    assert len(tok.index) <= 40 and b"word3" in tok.index and tok.held == sum(map(len, tok.index))


def test_caches_of_other_operators_are_emptied():
    from siftline.llm import common, neardup

    wordtok.for_path(PATH)
    common.enter("neardup")
    assert not wordtok._cached
    neardup.shingles(b"a b c d e f")
    assert neardup._words and wordtok.for_path(PATH) and not neardup._words


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), min_size=1, max_size=5))
def test_pieces_of_a_file_make_one_file(parts):
    """Added in parts, a file is the same as at once."""
    import io

    sizes = [len(p) for p in parts]
    whole = dac.encode(np.array(sum(parts, []), np.uint32), list(range(len(parts))), np.array(sizes))
    held, out = dac.Encoder(), io.BytesIO()
    for i, p in enumerate(parts):
        held.add(np.array(p, np.uint32), [i], np.array([len(p)]))
    assert held.write(out) == len(out.getvalue()) and out.getvalue() == whole
    file = dac.Reader(whole)
    assert [list(file.document(k)) for k in range(len(parts))] == parts
    assert all(file[i] == v for i, v in list(enumerate(sum(parts, [])))[::97])


def test_one_key_and_text_in_a_third_of_all_rows(spark):
    rows = [(None, "the same text") for _ in range(40)] + [(i, f"text {i}") for i in range(80)] + [(500, " ".join(f"w{i}" for i in range(100_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(dac.round_trip(df, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 40 + [*range(80), 500]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sum(r.length for r in packing.pieces(df, PATH).collect()) == at


def test_full_cache_is_cleared():
    tok = wordtok.WordTokenizer(PATH, max_words=3)
    for t in ("one two three four five", "six one two", "two"):
        assert list(tok.encode([t.encode()])[0]) == brute([t], 0)[0][:-1]


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_cover_every_document_once(spark, window):
    want = brute(TEXTS, packing.END_ID)
    df = packing.pieces(rows(spark).repartition(3), PATH, window)
    got = df.collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen.get(r.doc_id, 0) and r.offset + r.length <= window
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(piece) and r.ids_crc32 == crc(piece) and r.doc_tokens == len(want[r.doc_id])
        assert list(np.frombuffer(r.ids, "<u4")) == piece
        seen[r.doc_id] = r.start + r.length
    assert seen == {i: len(w) for i, w in enumerate(want)}
    total = sum(map(len, want))
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert fill == {s: min(window, total - s * window) for s in range(-(-total // window))}
    whole = {r.sequence_id: r for r in packing.sequences(df).collect()}
    assert {s: r.n_tokens for s, r in whole.items()} == fill
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole.values())


def test_pieces_of_nothing(spark):
    assert packing.pieces(rows(spark, []), PATH).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), max_size=5))
def test_codes_round_trip(docs):
    flat = np.array([i for d in docs for i in d], np.uint32)
    file = dac.Reader(dac.encode(flat, [None, *range(len(docs) - 1)][: len(docs)], np.array([len(d) for d in docs], np.int64)))
    assert [file[i] for i in range(len(flat))] == list(flat)
    assert [list(file.document(k)) for k in range(len(docs))] == docs
    assert file.doc_ids == [None, *range(len(docs) - 1)][: len(docs)]


def test_codes_across_rank_blocks():
    ids = (np.arange(5000) * 7919 % 70000).astype(np.uint32)
    file = dac.Reader(dac.encode(ids, [1], np.array([5000])))
    assert all(file[i] == ids[i] for i in range(0, 5000, 37))
    assert all((file.range(a, a + 700) == ids[a : a + 700]).all() for a in range(0, 4300, 311))
    with pytest.raises(ValueError):
        dac.Reader(b"none")


def test_token_files(spark):
    want = brute(TEXTS, dac.END_ID)
    got = {r.doc_id: r for r in dac.round_trip(rows(spark).repartition(3), PATH).collect()}
    at = 0
    for i, w in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(w), crc(w))
        at += len(w)
    assert len(got) == len(want)


def test_token_files_null_key_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (0, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in dac.round_trip(df, PATH).collect())
    assert got == [(0, None, 2), (2, 0, 1), (3, 1, 2), (5, 1, 2)]


def test_token_files_of_nothing(spark):
    assert dac.round_trip(rows(spark, []), PATH).count() == 0
