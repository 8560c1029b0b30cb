"""Records as JSON text with members laid over, in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(record: Column, over: Column) -> Column:
    """Two objects as one; they share no member."""
    body = F.regexp_replace(record, r"\s*\}\s*$", "")
    return F.concat(body, F.when(body.rlike(r"^\s*\{\s*$"), "").otherwise(", "), F.substr(over, F.lit(2)))


def overlaid(record: Column, fields: Sequence[str]) -> Column:
    """``record`` (the text of a JSON object) with the columns ``fields`` as members, which win over
    its own of the same name.  A null column is a null member.

    A record without any of them keeps its text as it came; of others the members that stay are written
    anew, by name.
    """
    if not fields:
        return record
    over = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    names = F.array(*(F.lit(f) for f in fields))
    rest = F.map_filter(F.try_parse_json(record).cast("map<string,variant>"), lambda k, _: ~k.isin(*fields))
    return F.when(F.arrays_overlap(F.json_object_keys(record), names), _joined(F.to_json(rest), over)).otherwise(_joined(record, over))
