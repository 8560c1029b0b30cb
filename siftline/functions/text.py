"""Text and value normalisation as column expressions (no Python in the plan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space including the information separators and next line.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Identity fields, most trusted first.
KEY_FIELDS = ("paper_id", "id", "openreview_id", "doi", "url", "pdf_url")
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"
_INT = r"^[+-]?\d+(_\d+)*$"


def clean_text(c: Column, max_chars: int = 0) -> Column:
    """One space for every white-space run, trimmed; null is empty.

    A result longer than ``max_chars`` (if positive) is cut there and marked with " ...".
    """
    out = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), WHITE, " "))
    if max_chars > 0:
        out = F.when(F.length(out) > max_chars, F.concat(F.substring(out, 1, max_chars), F.lit(" ..."))).otherwise(out)
    return out


def search_blob(*fields: Column) -> Column:
    """Lower-cased cleaned fields; an empty field still leaves its separator."""
    return F.lower(F.concat_ws(" ", *(clean_text(f) for f in fields)))


def blank_to_null(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def first_text(*columns: Column) -> Column:
    """The first text that is neither null nor empty, else the empty text."""
    return F.coalesce(*(blank_to_null(c) for c in columns), F.lit(""))


def first_number(*columns: Column) -> Column:
    """The first number that is neither null nor zero, else zero."""
    return F.coalesce(*(F.when(c != 0, c.cast("double")) for c in columns), F.lit(0.0))


def to_double(c: Column, default: float | None = 0.0) -> Column:
    """Decimal text to double: underscores between digits pass, type suffixes do not."""
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(_FLOAT), F.regexp_replace(text, "_", "").try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def to_int(c: Column, default: int | None = None) -> Column:
    """Whole-number text to long; "2025.0" is not one."""
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(_INT), F.regexp_replace(text, "_", "").try_cast("long"))
    return value if default is None else F.coalesce(value, F.lit(default))


def truthy_text(c: Column) -> Column:
    """JSON truthiness of a value rendered as text, where strings keep their quotes."""
    return F.when(c.isNull(), False).when(c.isin("null", "false", "0", "0.0", '""', "[]", "{}", ""), False).otherwise(True)


def paper_key(columns: Sequence[str], title: Column, venue: Column, year: Column) -> Column:
    """``field::value`` of the first filled identity field, else a digest of title, venue, year."""
    # the number 0 is no identity, the text "0" is one
    given = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "") & ((F.typeof(F.col(f)) == "string") | (F.col(f).cast("string") != "0"))
    fields = [F.when(given(f), F.concat(F.lit(f"{f}::"), F.col(f).cast("string"))) for f in KEY_FIELDS if f in columns]
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digest = F.concat(F.lit("sha1::"), F.sha1(F.concat_ws("::", text(title), text(venue), text(year))))
    return F.coalesce(*fields, digest)


def title_case_label(c: Column) -> Column:
    """``some_key`` as "Some Key"."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def first_json_object(reply: Column) -> Column:
    """The first decodable JSON object in noisy text, as VARIANT; null without one.

    Code fences are removed; then each opening brace in turn is tried.
    """
    text = F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"^```(?:json)?\s*|\s*```$", "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)) == "{")
    tried = F.transform(starts, lambda i: F.try_parse_json(F.substr(text, i)))
    found = F.filter(tried, lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))
    return F.get(found, F.lit(0))
