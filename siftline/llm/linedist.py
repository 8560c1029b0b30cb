"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines: every block tag, opening or closing, ends a line, so blank lines
stand where containers close and open.  A line weighs as many characters as it has outside links.
The block sum at a line adds the weights of ``WINDOW`` lines from there.  A run of lines surges
where its block sum leaves zero and dives where it returns there: two blank lines, or links alone,
part it from the next.  Runs whose sum reaches ``SURGE`` are kept, or else the heaviest run; with
them go shorter runs of the same container, which only an inner container had parted, and lines of
links between two kept lines of one container.

Where a page says what its parts are, that decides a line's weight.  Lines in a menu, header,
footer, sidebar, form, advert or the like, by element or by class, weigh nothing and are not
reported; where an article or main part has text, so is it with all lines outside.  A part that
holds most of the page's text (all of it, where an element or a class word of its own names it) cannot
be beside the text, whatever it is called, nor can one that holds an article or main part, unless
most of the text that is in such parts is elsewhere; of readers' comments, which may well be longer than
what they comment on, any elsewhere will do.  Of several articles, those with less than a fifth
of the largest one's text are teasers, or comments within it, and go.

Defined results: null or empty html gives the empty text; broken markup is read as far as it
goes (unclosed paragraphs end at the next block, unclosed parts at the end of what encloses
them); a page takes time in proportion to its length; rows are read each alone, so repeats and
ties do not matter; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common

WINDOW = 2
#: Characters in a window from which a run is text rather than remains of a menu.
SURGE = 80
#: Share of a page's text, in hundredths, from which a part cannot be beside it: a part named by
#: its element or a whole class word, and one by a word within a compound.
NAMED, COMPOUND = 95, 50

# Fixed values of HTML: element names by role.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: No text that a reader is shown as such.
SILENT = frozenset("script style head title noscript iframe template svg button select textarea dialog object applet canvas audio video".split())
ASIDE = frozenset("nav header footer aside form menu search".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that hold blocks rather than being one.
HOLDERS = frozenset("article body center div main section td".split())
#: Words in class, id or role that mark parts beside the text.
BESIDE = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead topbar header footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus replies related recommended share sharing social widget widgets toolbar pagination pager skip complementary contentinfo search alert dialog hidden".split()
)
#: Of these, what may well hold more text than the article, and what an article may be marked by.
COMMENTS = frozenset("comment comments respond disqus replies commentlist".split())
LESSER = COMMENTS | frozenset("ad ads advert promo promoted sponsored related recommended teaser teasers".split())
#: Words that turn a compound: with-sidebar, no-ads, ad-free, comments-open; and what heads an article: entry-header.
TURNS_FIRST = frozenset("with has have no not non without show hide".split())
TURNS_LAST = frozenset("free less off layout page wrapper container body content open closed on enabled disabled".split())
HEADS_FIRST = frozenset("entry post article story content".split())
HEADS_LAST = frozenset("header masthead banner".split())
#: Share of the largest article's text, in hundredths, below which another one is beside it.
TEASER = 20

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|$)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$))", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[_\-]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.I) for t in RAW}

OUT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def _class_mark(word: str) -> tuple[int, bool]:
    """``NAMED`` or ``COMPOUND`` for a class word that marks a part beside the text, else 0; and whether
    it names readers' comments."""
    if word in BESIDE or word in COMMENTS:
        return NAMED, word in COMMENTS
    parts = [p for p in _SPLIT.split(word) if p]
    if len(parts) < 2 or parts[0] in TURNS_FIRST:
        return 0, False
    if parts[0] in HEADS_FIRST and parts[-1] in HEADS_LAST:
        return 0, False
    # comment-body and post-comments are comments, whatever else turns
    if COMMENTS & {*parts} and parts[-1] not in TURNS_LAST - {"body", "content", "container", "wrapper"}:
        return NAMED, True
    if parts[-1] in TURNS_LAST:
        return 0, False
    return (COMPOUND if {parts[0], parts[-1]} & BESIDE else 0), False


def _mark(name: str, attributes: str, in_article: bool) -> tuple[int, bool, bool]:
    """What marks an element as beside the text, whether that is comments, and whether a reader never
    sees it."""
    mark, comments = NAMED if name in ASIDE and not (name == "header" and in_article) else 0, False
    if attributes and name not in ("main", "html", "body"):
        for key, value in _ATTR.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                if name not in ARTICLE:
                    return mark, comments, True
            if key in ("class", "id", "role"):
                for word in value.split():
                    if name in ARTICLE and not LESSER & {word, *_SPLIT.split(word)}:
                        continue
                    of_word = _class_mark(word)
                    mark, comments = max(mark, of_word[0]), comments or of_word[1]
    return mark, comments, False


@dataclass
class Line:
    """A line of a page: its text, its characters outside links, where it stands."""

    text: str = ""
    weight: int = 0
    #: number of the article or main part it is in, of the innermost article, of the innermost container and
    #: of the innermost marked part; 0 without
    article: int = 0
    piece: int = 0
    holder: int = 0
    part: int = 0


@dataclass
class Part:
    """A marked part: its mark, whether it is comments, the marked part around it, its characters, those of
    them in articles, whether an article or main part begins in it."""

    mark: int
    comments: bool
    outer: int
    chars: int = 0
    in_articles: int = 0
    article: bool = False


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    parts: list[Part] = field(default_factory=lambda: [Part(0, False, 0)])


@dataclass
class _Open:
    """An element that is open, and what held before it."""

    name: str
    silent: bool
    article: int
    piece: int
    holder: int
    part: int


class _Reader:
    """One pass over a page's tags."""

    def __init__(self):
        self.page = Page()
        self.stack: list[_Open] = []
        #: places of open block elements, and how many are open by name
        self.blocks: list[int] = []
        self.names: Counter = Counter()
        self.article = self.piece = self.holder = self.part = self.silent = self.opened = 0
        self.words: list[str] = []
        self.linked: list[str] = []

    def add(self, text: str) -> None:
        if not self.silent:
            self.words.append(text)
            if self.names["a"]:
                self.linked.append(text)

    def end(self) -> None:
        """End the line; what has no text is a blank line, of which ``WINDOW`` tell all."""
        text = " ".join("".join(self.words).split())
        weight = max(0, len(text) - len(" ".join("".join(self.linked).split()))) if text else 0
        self.words, self.linked = [], []
        lines = self.page.lines
        if text or any(x.text for x in lines[-WINDOW:]):
            lines.append(Line(text, weight, self.article, self.piece, self.holder, self.part))
            self.page.parts[self.part].chars += weight
            self.page.parts[self.part].in_articles += weight if self.article else 0

    def open(self, name: str, attributes: str) -> None:
        mark, comments, unseen = _mark(name, attributes, self.article > 0)
        silent = unseen or name in SILENT
        self.stack.append(_Open(name, silent, self.article, self.piece, self.holder, self.part))
        self.opened += 1
        self.silent += silent
        self.names[name] += 1
        if name in BLOCKS:
            self.blocks.append(len(self.stack) - 1)
        if mark:
            self.page.parts.append(Part(mark, comments, self.part))
            self.part = len(self.page.parts) - 1
        if name in ARTICLE and not silent:
            self.article = self.article or self.opened
            self.piece = self.opened if name == "article" else self.piece
            # outer parts learn of it when all is read
            self.page.parts[self.part].article = True
        if name in HOLDERS:
            self.holder = self.opened

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            top = self.stack.pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.silent -= top.silent
            self.names[top.name] -= 1
            self.article, self.piece, self.holder, self.part = top.article, top.piece, top.holder, top.part

    def closing(self, name: str) -> None:
        if name in BLOCKS:
            self.end()
        if self.names[name]:
            at = len(self.stack) - 1
            while self.stack[at].name != name:
                at -= 1
            self.close(at)

    def implied(self, name: str) -> None:
        """An open paragraph ends where a block begins, an open item where the next begins."""
        if self.blocks:
            last = self.stack[self.blocks[-1]].name
            if last == "p" or last == name and name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                self.close(self.blocks[-1])


def read(page: str) -> Page:
    """Strip markup to lines."""
    r = _Reader()
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            r.add(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        if m[1] or m[5]:
            r.closing(name)
            continue
        if name in VOID or m[4] and name not in BLOCKS | RAW:
            if name == "br":
                r.add(" ")
            elif name == "hr":
                r.end()
            continue
        if name in BLOCKS:
            r.end()
            r.implied(name)
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else n
            continue
        r.open(name, m[3] if m[2] else m[7])
    r.end()
    parts = r.page.parts
    for p in reversed(parts[1:]):
        parts[p.outer].chars += p.chars
        parts[p.outer].in_articles += p.in_articles
        parts[p.outer].article |= p.article
    return r.page


def beside(page: Page) -> list[bool]:
    """Whether each marked part is beside the text, with all in it."""
    whole = page.parts[0]
    out = [False]
    for p in page.parts[1:]:
        elsewhere = whole.in_articles - p.in_articles
        if p.article:
            aside = elsewhere > (0 if p.comments else p.in_articles)
        else:
            # comments on an article may be longer than it, as long as there is one
            aside = p.chars * 100 < max(1, whole.chars) * p.mark or p.comments and elsewhere > 0
        out.append(out[p.outer] or aside)
    return out


def lesser(lines: list[Line], shown: list[bool]) -> set[int]:
    """Articles that have too little of the text to be it."""
    held: Counter = Counter()
    for s, x in zip(shown, lines, strict=True):
        if s and x.piece:
            held[x.piece] += len(x.text)
    most = max(held.values(), default=0)
    return {piece for piece, n in held.items() if n * 100 < most * TEASER}


def runs(weights: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, heaviest block sum) of each stretch of block sums above zero."""
    n = len(weights)
    sums, held = [0] * n, 0
    for i in range(n - 1, -1, -1):
        held += weights[i] - (weights[i + WINDOW] if i + WINDOW < n else 0)
        sums[i] = held
    out, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        out.append((i, j, max(sums[i:j])))
        i = j
    return out


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by newlines."""
    if not page:
        return ""
    found = read(page)
    aside = beside(found)
    lines = found.lines
    shown = [bool(x.text) and not aside[x.part] for x in lines]
    if any(s and x.article for s, x in zip(shown, lines, strict=True)):
        shown = [s and x.article > 0 for s, x in zip(shown, lines, strict=True)]
        small = lesser(lines, shown)
        shown = [s and x.piece not in small for s, x in zip(shown, lines, strict=True)]
        # links between the article's own lines weigh as text there
        weights = [len(x.text) if s else 0 for s, x in zip(shown, lines, strict=True)]
        place = [x.article for x in lines]
    else:
        weights = [x.weight if s else 0 for s, x in zip(shown, lines, strict=True)]
        place = [x.holder for x in lines]
    stretches = runs(weights)
    if not stretches:
        return ""
    text_of = lambda r: [i for i in range(r[0], r[1]) if shown[i]]
    kept = [r for r in stretches if r[2] >= SURGE] or [max(stretches, key=lambda r: (sum(weights[r[0] : r[1]]), -r[0]))]
    #: of each container with kept text, its first and last line of it
    spans: dict[int, list[int]] = {}
    for i in (i for r in kept for i in text_of(r)):
        spans.setdefault(place[i], [i, i])[1] = i
    chosen = {i for r in stretches if r in kept or any(place[i] in spans for i in text_of(r)) for i in text_of(r)}
    # lines of links alone that stand between kept ones are part of the text
    chosen |= {i for i, s in enumerate(shown) if s and place[i] in spans and spans[place[i]][0] < i < spans[place[i]][1]}
    return "\n".join(lines[i].text for i in sorted(chosen))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and its code points, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("pages")
        for batch in common.slices(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], OUT.names)

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, OUT)
