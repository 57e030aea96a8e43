"""Arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zip_shortest(a: Column, b: Column) -> Column:
    """Pairs up to the shorter length, where ``arrays_zip`` would pad with null."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


def zip_to_map(keys: Column, values: Column) -> Column:
    n = F.least(F.size(keys), F.size(values))
    return F.map_from_arrays(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n))


def swap_ends(a: Column) -> Column:
    n = F.size(a)
    whole = F.concat(F.slice(a, n, F.lit(1)), F.slice(a, F.lit(2), F.greatest(n - 2, F.lit(0))), F.slice(a, F.lit(1), F.lit(1)))
    return F.when(n >= 2, whole).otherwise(a)


def merge_maps(a: Column, b: Column) -> Column:
    """Where both have a key, b's value holds. Independent of the session's policy for double keys."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def without_key(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def get_or(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def map_from_pairs(pairs: Column) -> Column:
    """From structs (k, v); the last of equal keys holds."""
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def map_from_two_characters(texts: Column) -> Column:
    """From texts of two characters, key and value."""
    return map_from_pairs(F.transform(texts, lambda t: F.struct(F.left(t, F.lit(1)).alias("k"), F.substr(t, F.lit(2), F.lit(1)).alias("v"))))


def map_where(a: Column, keep, value) -> Column:
    """{x: value(x) for x in a if keep(x)}."""
    kept = F.array_distinct(F.filter(a, keep))
    return F.map_from_arrays(kept, F.transform(kept, value))


def truth(a: Column) -> Column:
    """Whether an array has elements; null counts as empty."""
    return F.coalesce(F.size(a) > 0, F.lit(False))
