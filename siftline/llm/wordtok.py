"""Tokenizer calls by distinct word.

The vocabulary in use drops white space and never merges across it, so the ids of a text are
the ids of its white-space-separated words in turn.  A distinct word goes through the tokenizers
library when a worker meets it; repeats cost one dict lookup.  When the cache is full, the words
that came back most stay and the rest go, so memory stays bounded (some 80 MB) whatever the
vocabulary of the corpus.
"""

from __future__ import annotations

import os
import re

import numpy as np

from siftline.llm import common

#: Words, bytes of words and parts of words that a worker keeps.
MAX_WORDS, MAX_BYTES, MAX_PARTS = 400_000, 16 << 20, 120_000
#: Text bytes that a task turns into ids at once.
TEXT_BYTES = 2 << 20

#: What the vocabulary's own normalizer and splitter do to words of these characters is plain:
#: lower case, then contractions, runs of letters, single digits, runs of anything else.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_PLAIN_CONFIG = r"""'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"""


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, else as 256 + its turn."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b if b in prints else 256 + others.index(b)) for b in range(256)}


class _Index(dict):
    """word -> position; an unknown word gets the next position and waits in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.pending.append(word)
        return n


class WordTokenizer:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark_id, self.mark = next((i, t.content) for i, t in sorted(added.items()))
        self.specials = [t.content.encode() for t in added.values()]
        self.max_words, self.max_bytes = max_words, max_bytes
        # the short way needs a splitter of exactly this kind; else every word goes the long way
        self.short = _PLAIN_CONFIG in self.tokenizer.to_str() and '"NFC"' in self.tokenizer.to_str()
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        #: one object for each id, whatever the number of words it is in
        self.ids = list(range(self.tokenizer.get_vocab_size()))
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.parts: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int32)
        self.lens = np.empty(1 << 14, np.int32)
        self.known = 0
        #: how often the word of each position came
        self.uses = np.zeros(1 << 14, np.uint32)

    def _thin(self) -> None:
        """Keep the words that came most, to a third of the bounds, and forget the others."""
        words, uses = list(self.index), self.uses[: self.known].copy()
        order = np.argsort(uses, kind="stable")[::-1]
        order = order[uses[order] > 1][: self.max_words // 3]
        held = np.cumsum(np.fromiter((len(words[i]) for i in order.tolist()), np.int64, len(order)))
        order = np.sort(order[: int(np.searchsorted(held, self.max_bytes // 3, "right"))])
        old, starts, lens = self.flat, self.starts[order], self.lens[order]
        self._clear()
        for i, at in enumerate(order.tolist()):
            self.index[words[at]] = i
        self._room(len(order), int(lens.sum()))
        self.known, self.used = len(order), int(lens.sum())
        self.held = sum(len(words[i]) for i in order.tolist())
        ends = np.cumsum(lens)
        self.flat[: self.used] = old[np.repeat(starts - (ends - lens), lens) + np.arange(self.used)]
        self.starts[: self.known], self.lens[: self.known] = ends - lens, lens
        # older words count for less than those to come
        self.uses[: self.known] = uses[order] // 2

    def _room(self, words: int, ids: int) -> None:
        """Grow the arrays so that so many more words and ids fit."""
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.known + words > len(self.starts):
            self.starts = np.concatenate((self.starts, np.empty_like(self.starts)))
            self.lens = np.concatenate((self.lens, np.empty_like(self.lens)))
            self.uses = np.concatenate((self.uses, np.zeros_like(self.uses)))

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of what the splitter would hand to the model."""
        if not part.isascii():
            part = "".join(map(self.letters.__getitem__, part.encode()))
        ids = self.ids
        return tuple([ids[t.id] for t in self.model.tokenize(part)])

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word."""
        if not self.short:
            return self._encode_long(words)
        flat: list[int] = []
        lens = np.empty(len(words), np.int64)
        odd, places, known, model = [], [], self.parts, self._part
        for i, w in enumerate(words):
            text = str(w, "utf-8", "replace")
            if not _PLAIN.fullmatch(text) or "<|" in text:
                odd.append(w)
                places.append((i, len(flat)))
                continue
            before = len(flat)
            for part in _PARTS.findall(text.lower()):
                ids = known.get(part)
                if ids is None:
                    ids = known[part] = model(part)
                flat += ids
            lens[i] = len(flat) - before
        if not odd:
            return np.array(flat, np.uint32), lens
        ids, sizes = self._encode_long(odd)
        out, at, used = [], 0, 0
        plain = np.array(flat, np.uint32)
        for (i, place), n in zip(places, sizes, strict=True):
            out += [plain[at:place], ids[used : used + n]]
            lens[i], at, used = n, place, used + n
        return np.concatenate([*out, plain[at:]]), lens

    def _encode_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's whole way, all words in one call."""
        plain = [not any(s in w for s in self.specials) for w in words]
        if all(plain):
            # one call: a special token between words marks where each word ends
            text = self.mark.join(str(w, "utf-8", "replace") for w in words)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            edges = np.concatenate(([-1], cuts, [len(ids)]))
            return ids[ids != self.mark_id], np.diff(edges) - 1
        each = self.tokenizer.encode_batch([str(w, "utf-8", "replace") for w in words], add_special_tokens=False)
        return np.array([i for e in each for i in e.ids], np.uint32), np.array([len(e.ids) for e in each], np.int64)

    def _learn(self) -> None:
        if len(self.parts) > MAX_PARTS:
            self.parts.clear()
        for lo in range(0, len(self.index.pending), 20_000):
            words = self.index.pending[lo : lo + 20_000]
            ids, lens = self._encode(words)
            n, m = len(words), len(ids)
            self._room(n, m)
            self.flat[self.used : self.used + m] = ids
            self.starts[self.known : self.known + n] = self.used + np.cumsum(lens) - lens
            self.lens[self.known : self.known + n] = lens
            self.used += m
            self.known += n
            self.held += sum(map(len, words))
        self.index.pending = []

    def encode(self, texts: list[bytes | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in turn, and the number of ids of each text.

        ``end`` is appended to each text.  None counts as an empty text.
        """
        if len(self.index) > self.max_words or self.held > self.max_bytes:
            self._thin()
        look = self.index.__getitem__
        found = []
        for t in texts:
            words = t.split() if t else ()
            found.append(np.fromiter(map(look, words), np.int64, len(words)))
        if self.index.pending:
            self._learn()
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        self.uses[: self.known] += np.bincount(at, minlength=self.known).astype(np.uint32)
        lens = self.lens[at]
        edges = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        doc_edges = edges[np.concatenate(([0], np.cumsum(counts)))]
        total = int(edges[-1])
        ids = self.flat[np.repeat(self.starts[at] - edges[:-1], lens) + np.arange(total)]
        sizes = np.diff(doc_edges)
        if end is not None:
            ids = np.insert(ids, doc_edges[1:], end)
            sizes = sizes + 1
        return ids, sizes


_cached: dict[str, WordTokenizer] = {}
common.cached("wordtok", _cached.clear)


def for_path(path: str) -> WordTokenizer:
    """This worker's tokenizer; workers are reused, and so is what they have cached."""
    common.enter("wordtok")
    if path not in _cached:
        _cached[path] = WordTokenizer(path)
    return _cached[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
