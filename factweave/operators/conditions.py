"""Values that depend on conditions, as rows (tree, path, value): a path is a map from conditions to their values.

The paths of one tree exclude each other and cover all cases. Conditions have an order by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compatible(a: Column, b: Column) -> Column:
    """Whether two paths agree on the conditions they share."""
    return ~F.exists(F.map_keys(a), lambda k: F.coalesce(F.element_at(b, k) != F.element_at(a, k), F.lit(False)))


def lift(a: DataFrame, b: DataFrame, function) -> DataFrame:
    """(tree, path, value): ``function`` of both values wherever the paths of a's and b's equal trees agree."""
    other = b.select("tree", F.col("path").alias("_p"), F.col("value").alias("_v"))
    both = a.join(other, "tree").filter(compatible(F.col("path"), F.col("_p")))
    missing = F.map_filter("_p", lambda k, _: ~F.array_contains(F.map_keys("path"), k))
    return both.select("tree", F.map_concat("path", missing).alias("path"), function(F.col("value"), F.col("_v")).alias("value"))


def collapse(rows: DataFrame, condition: str, outcomes: int) -> DataFrame:
    """Drop a condition from paths where all its ``outcomes`` have one value."""
    rest = F.map_filter("path", lambda k, _: k != F.lit(condition))
    key = F.array_sort(F.map_entries(rest))
    groups = rows.filter(F.map_contains_key("path", condition)).groupBy("tree", key.alias("_k")).agg(F.count("*").alias("_n"), F.count_distinct("value").alias("_d"), F.first("value").alias("_v"))
    same = groups.filter((F.col("_n") == outcomes) & (F.col("_d") == 1))
    kept = rows.withColumn("_k", F.when(F.map_contains_key("path", condition), key)).join(same.select("tree", "_k"), ["tree", "_k"], "left_anti").select("tree", "path", "value")
    return kept.unionByName(same.select("tree", F.map_from_entries("_k").alias("path"), F.col("_v").alias("value")))


def restrict(rows: DataFrame, condition: str, value) -> DataFrame:
    """The trees where a condition has a given value."""
    at = F.element_at("path", F.lit(condition))
    return rows.filter(at.isNull() | (at == F.lit(value))).select("tree", F.map_filter("path", lambda k, _: k != F.lit(condition)).alias("path"), "value")


def if_then_else(test: DataFrame, yes: DataFrame, no: DataFrame) -> DataFrame:
    """yes where the boolean tree is true, no where it is false."""
    picked = lift(lift(test, yes, lambda t, v: F.struct(t.alias("t"), v.alias("y"))), no, lambda s, v: F.when(s["t"], s["y"]).otherwise(v))
    return picked


def maybe_true(rows: DataFrame) -> DataFrame:
    """(tree, maybe_true, maybe_false) of boolean trees."""
    return rows.groupBy("tree").agg(F.bool_or("value").alias("maybe_true"), F.bool_or(~F.col("value")).alias("maybe_false"))


def simplify(rows: DataFrame, domain: DataFrame, default) -> DataFrame:
    """Values on paths that the domain (tree, path, value boolean) excludes become ``default``."""
    return lift(rows, domain, lambda v, d: F.when(d, v).otherwise(F.lit(default)))
