"""JSON metadata as maps of text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def decode(c: Column) -> Column:
    """JSON object (text or bytes) -> ``map<string,string>``; anything else -> empty.

    Nested values keep their compact JSON text, JSON null becomes NULL.
    """
    parsed = F.from_json(c.cast("string"), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def unwrap(c: Column) -> Column:
    """Text of a nested JSON string value without its quotes and escapes."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"), c)


def as_variant(c: Column) -> Column:
    """Whole JSON value of any kind, NULL if it is not JSON."""
    return F.try_parse_json(c.cast("string"))
