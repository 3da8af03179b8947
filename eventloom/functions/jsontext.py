"""JSON text as maps, strictly read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_map(text: str | Column, values: str = "string") -> Column:
    """The fields of a JSON object by name; null for null, for text that isn't valid JSON and
    for JSON that is no object. One parser serves all rows, where parse_json makes one a row."""
    return F.from_json(text, f"map<string,{values}>", {"allowSingleQuotes": "false"})


def without_keys(text: str | Column, *keys: str) -> Column:
    """The JSON object without the named top-level fields; what is no JSON object stays as it is."""
    c = F.col(text) if isinstance(text, str) else text
    kept = F.map_filter(object_map(c, "variant"), lambda k, v: ~k.isin(*keys))
    return F.coalesce(F.to_json(kept), c)
