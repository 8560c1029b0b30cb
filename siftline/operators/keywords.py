"""Keywords of many profiles in one pass over a text.

All keywords of all profiles make one Aho-Corasick automaton, which a worker builds once; reading a text
takes time by its length and its matches, however many keywords there are.  Only the matching is done in
Python: texts are cleaned and lowered, and matches joined with nothing, in column expressions.
``rules.score`` is the form for one profile of few words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import text as tx
from siftline.operators import rules
from siftline.profile import Profile

FIELDS = ("title", "abstract", "keywords")
_SIDE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType()))])
MATCHED = T.ArrayType(T.StructType([T.StructField("profile", T.StringType()), T.StructField("positive", _SIDE), T.StructField("negative", _SIDE)]))
_BLOB, _FOUND = "_keyword_blob", "_keyword_found"


@dataclass(frozen=True)
class Entry:
    """A keyword where a profile names it: ``side`` 0 is positive, 1 negative; ``place`` is its turn."""

    profile: int
    side: int
    place: int
    keyword: str
    points: float


class Needles:
    """The distinct keywords of profiles, and who names each."""

    def __init__(self, profiles: Sequence[Profile]):
        self.names = [p.name for p in profiles]
        self.entries: dict[str, list[Entry]] = {}
        for i, p in enumerate(profiles):
            for side, words in enumerate((p.positive_keywords, p.negative_keywords)):
                for place, word in enumerate(words):
                    if needle := word.strip().lower():
                        self.entries.setdefault(needle, []).append(Entry(i, side, place, word, rules.PHRASE if " " in needle else rules.WORD))
        self._automaton = None

    def __getstate__(self) -> dict:
        # each worker builds its own
        return self.__dict__ | {"_automaton": None}

    def find(self, text: str) -> list[Entry]:
        """Whose keywords the text holds: by profile, side and turn."""
        if self._automaton is None and self.entries:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for needle in self.entries:
                self._automaton.add_word(needle, needle)
            self._automaton.make_automaton()
        held = {needle for _, needle in self._automaton.iter(text)} if text and self.entries else ()
        return sorted((e for needle in held for e in self.entries[needle]), key=lambda e: (e.profile, e.side, e.place))

    def sides(self, text: str) -> list[dict]:
        """Of every profile, points and matched keywords of both sides."""
        out = [{"profile": n, "positive": {"score": 0.0, "hits": []}, "negative": {"score": 0.0, "hits": []}} for n in self.names]
        for e in self.find(text):
            side = out[e.profile]["negative" if e.side else "positive"]
            side["score"] += e.points
            side["hits"].append(e.keyword)
        return out


def _matched(papers: DataFrame, needles: Needles, fields: Sequence[str]) -> DataFrame:
    own = [c for c in papers.columns if c not in (_BLOB, _FOUND)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            found = [needles.sides(t or "") for t in batch.column(_BLOB).to_pylist()]
            if kind is None:
                side = pa.struct([("score", pa.float64()), ("hits", pa.list_(pa.string()))])
                kind = pa.list_(pa.struct([("profile", pa.string()), ("positive", side), ("negative", side)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(found, kind)], [*own, _FOUND])

    blob = tx.search_blob(*(F.col(f) for f in fields))
    schema = T.StructType([*(papers.schema[c] for c in own), T.StructField(_FOUND, MATCHED)])
    return papers.select(*own, blob.alias(_BLOB)).mapInArrow(run, schema)


def score(papers: DataFrame, profiles: Sequence[Profile], fields: Sequence[str] = FIELDS, carry: Sequence[str] | None = None) -> DataFrame:
    """One row for each paper and profile: ``carry`` (all columns by default), profile_name and the
    columns of ``rules.score``."""
    own = [c for c in (papers.columns if carry is None else carry) if c != "profile_name" and not c.startswith("rule_")]
    found = _matched(papers.select(*dict.fromkeys([*own, *fields])), Needles(profiles), fields)
    each = found.select(*own, F.explode(_FOUND).alias("_r"))
    up, down = F.col("_r.positive.score"), F.col("_r.negative.score")
    return each.select(
        *own,
        F.col("_r.profile").alias("profile_name"),
        up.alias("rule_positive_score"),
        down.alias("rule_negative_score"),
        F.col("_r.positive.hits").alias("rule_positive_hits"),
        F.col("_r.negative.hits").alias("rule_negative_hits"),
        F.round(up - F.lit(rules.PENALTY) * down, 4).alias("rule_score"),
    )


def hits(papers: DataFrame, profiles: Sequence[Profile], key: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(profile, keyword, negative, key): every keyword that a paper holds, once for each profile."""
    scored = score(papers.withColumn("_keyword_key", F.col(key)), profiles, fields, carry=["_keyword_key"])
    tagged = lambda c, negative: F.transform(F.array_distinct(c), lambda k: F.struct(k.alias("keyword"), F.lit(negative).alias("negative")))
    each = scored.select("_keyword_key", "profile_name", F.explode(F.concat(tagged("rule_positive_hits", False), tagged("rule_negative_hits", True))).alias("h"))
    return each.select(F.col("profile_name").alias("profile"), "h.keyword", "h.negative", F.col("_keyword_key").alias(key))


def counts(papers: DataFrame, profiles: Sequence[Profile], fields: Sequence[str] = FIELDS) -> DataFrame:
    """(profile, keyword, negative, n_papers)."""
    found = hits(papers.withColumn("_one", F.lit(1)), profiles, "_one", fields)
    return found.groupBy("profile", "keyword", "negative").agg(F.count(F.lit(1)).alias("n_papers"))
