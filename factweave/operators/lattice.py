"""Lattice aggregates: unions, intersections and flags, with null for the empty set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def or_null(s: Column) -> Column:
    """A set, or null if it is empty."""
    return F.when(F.size(s) > 0, s)


def union(value: str) -> Column:
    """Aggregate: the sorted union of set columns; nulls count as empty."""
    return or_null(F.array_sort(F.array_distinct(F.flatten(F.collect_list(value)))))


def union_of_elements(value: str) -> Column:
    """Aggregate: the sorted set of single elements, which each task combines first."""
    return or_null(F.array_sort(F.collect_set(value)))


def intersection(rows: DataFrame, keys: list[str], source: str, value: str) -> DataFrame:
    """keys and ``elements``: the elements (value) that all sources of a key have; by counting, so no sets are collected
    before they are small."""
    pairs = rows.select(*keys, source, value).distinct()
    sources = pairs.groupBy(*keys).agg(F.count_distinct(source).alias("_n"))
    held = pairs.groupBy(*keys, value).agg(F.count("*").alias("_m")).join(sources, keys)
    kept = held.filter("_m = _n").groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("elements"))
    return sources.select(*keys).join(kept, keys, "left")


def merge(a: Column, b: Column) -> tuple[Column, Column]:
    """The union of two sets and whether it is more than the first."""
    empty = F.array_except(F.coalesce(a, b), F.coalesce(a, b))
    both = F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))
    return or_null(both), F.coalesce(F.size(or_null(both)), F.lit(0)) != F.coalesce(F.when(a.isNotNull(), F.size(a)), F.lit(0))


def widened(rows: DataFrame, key: str, kind: str, most: int = 4) -> DataFrame:
    """(key, kind): the distinct kinds of each key, or one row 'any' where there are more than ``most``."""
    kinds = rows.select(key, F.col(kind).cast("string").alias("kind")).distinct()
    count = kinds.groupBy(key).agg(F.count("*").alias("_n"))
    named = kinds.join(count, key)
    return named.filter(F.col("_n") <= most).select(key, "kind").union(count.filter(F.col("_n") > most).select(key, F.lit("any")))


def escape_flags(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """(key, flags): bitwise or."""
    return rows.groupBy(key).agg(F.bit_or(flag).alias("flags"))


def both_ways(l: Column, r: Column) -> dict[str, Column]:
    """Three-valued logic over nullable booleans: null is maybe."""
    return {
        "not_l": ~l, "and_lr": l & r, "or_lr": l | r, "xor_lr": l != r,
        "l_must": F.coalesce(l, F.lit(False)), "l_must_not": F.coalesce(~l, F.lit(False)), "l_maybe_true": F.coalesce(l, F.lit(True)), "l_maybe_false": F.coalesce(~l, F.lit(True)), "l_certain": l.isNotNull(),
    }
