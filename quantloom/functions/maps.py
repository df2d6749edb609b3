"""Maps and arrays in document order, and names of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs(text: Column, value: str = "double") -> Column:
    """A JSON object as an array of (key, value) in document order; null for null or malformed text."""
    m = F.from_json(text, f"map<string,{value}>", {"mode": "PERMISSIVE"})
    return F.when(text.isNotNull() & m.isNotNull(), F.arrays_zip(F.map_keys(m).alias("key"), F.map_values(m).alias("value")))


def first_within(levels: Column, price: str, low: Column, high: Column, value: str, least: Column | float) -> Column:
    """The first element whose price lies in [low, high] and whose value is at least `least`; null if none."""
    return F.get(F.filter(levels, lambda x: (x[price] >= low) & (x[price] <= high) & (x[value] >= least)), F.lit(0))


def summed(a: Column, b: Column) -> Column:
    """Two arrays of (key, value) as one: values of equal keys added, keys in order of first appearance; a null array counts as empty."""
    none = F.filter(F.coalesce(a, b), lambda x: F.lit(False))
    both = F.concat(F.coalesce(a, none), F.coalesce(b, none))
    keys = F.array_distinct(F.transform(both, lambda x: x["key"]))
    total = lambda k: F.aggregate(F.filter(both, lambda x: x["key"].eqNullSafe(k)), F.lit(0.0), lambda s, x: s + F.coalesce(x["value"], F.lit(0.0)))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), total(k).alias("value")))


def merged_notes(a: Column, b: Column) -> Column:
    """Two JSON objects of texts as one; of a key in both the second's value holds; null and malformed ones count as empty."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(read(a), lambda k, v: ~F.map_contains_key(read(b), k))
    return F.to_json(F.map_concat(kept, read(b)))


def column_parts(name: str) -> dict[str, str | bool]:
    """scope, history?, measure of a detector's column named {scope}_[hist_]{measure}; scope '' if there is none."""
    m = re.fullmatch(r"(?:(gbx|rth|on)_)?(hist_)?(.+)", name)
    return {"scope": m.group(1) or "", "history": bool(m.group(2)), "measure": m.group(3)}
