"""Operators that depend on order: as-of dependences, traces, versions, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def memory_dependences(ops: DataFrame, compat: bool = True) -> DataFrame:
    """(src, dst, kind) over ops (op, ts, slot, mode): the last write before each read (RAW) and each write (WAW).

    Without ``compat`` also WAR: the reads since the last write before each write. A slot's operations need one window
    over its own order; nothing is joined, but for WAR, which joins reads to the one next write.
    """
    w = Window.partitionBy("slot").orderBy("ts", "op")
    write = F.when(F.col("mode") == "write", F.col("op"))
    last = F.last(write, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = ops.withColumns({"src": last, "next": F.first(write, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    out = seen.filter("src is not null").select("src", F.col("op").alias("dst"), F.when(F.col("mode") == "read", "RAW").otherwise("WAW").alias("kind"))
    if compat:
        return out
    return out.unionByName(seen.filter("mode = 'read' and next is not null").select(F.col("op").alias("src"), F.col("next").alias("dst"), F.lit("WAR").alias("kind")))


def transitions(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The rows with ``previous``: the value before in the key's order, null at its start."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def versions(definitions: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The rows with ``version``: 1, 2, ... in each key's order."""
    return definitions.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def prefix_minima(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The rows with ``least``: the least value up to each row in the key's order."""
    return rows.withColumn("least", F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def range_minimum(rows: DataFrame, key: str, at: str, value: str, queries: DataFrame) -> DataFrame:
    """queries (key, lo, hi) with ``least``: the least value at lo <= at < hi of the key.

    A sparse table: for each power of two the minima of blocks that start at each row. One window over rows and ends of
    ranges gives the first and last row of each range; a query then joins at most two blocks on equality, however long its
    range is. Ranges without rows are left out.
    """
    w = Window.partitionBy(key).orderBy(at)
    seq = rows.select(key, at, value, F.row_number().over(w).alias("i"))
    size = seq.groupBy(key).agg(F.max("i").alias("n"))
    depth = seq.join(size, key).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.log2("n")).cast("int"))))
    ends = depth.filter(F.col("i") + F.pow(F.lit(2.0), F.col("k")) - 1 <= F.col("n"))
    blocks = None
    top = size.agg(F.max(F.floor(F.log2("n")))).first()[0]
    for k in range(int(top if top is not None else -1) + 1):
        part = ends.filter(F.col("k") == k).select(key, "i", F.min(value).over(Window.partitionBy(key).orderBy("i").rowsBetween(0, 0)).alias("least")) if k == 0 else seq.select(key, "i", F.min(value).over(Window.partitionBy(key).orderBy("i").rowsBetween(0, (1 << k) - 1)).alias("least"))
        part = part.withColumn("k", F.lit(k))
        blocks = part if blocks is None else blocks.unionByName(part)
    q = written(queries.withColumn("_q", F.monotonically_increasing_id()))  # both ends of a range must see one number
    rows_ = rows.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_one"), F.lit(None).cast("long").alias("_q"), F.lit(False).alias("_high"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    end = lambda c, high: q.select(F.col(key), F.col(c).alias("_at"), F.lit(0).alias("_one"), "_q", F.lit(high).alias("_high"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    before = F.sum("_one").over(Window.partitionBy(key).orderBy("_at", "_one").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # rows under an end, as ends come first
    placed = rows_.unionByName(end("lo", False)).unionByName(end("hi", True)).withColumn("_n", before).filter("_one = 0")
    span = placed.groupBy("_q", key, "lo", "hi").agg((F.max(F.when(~F.col("_high"), F.col("_n"))) + 1).alias("a"), F.max(F.when(F.col("_high"), F.col("_n"))).alias("b")).filter("a <= b")
    span = span.withColumn("k", F.floor(F.log2(F.col("b") - F.col("a") + 1)).cast("int"))
    both = span.withColumn("i", F.explode(F.array(F.col("a"), (F.col("b") - F.pow(F.lit(2.0), F.col("k")) + 1).cast("int"))))
    return both.join(blocks, [key, "i", "k"]).groupBy("_q", key, "lo", "hi").agg(F.min("least").alias("least")).drop("_q")


def excerpt(lines: DataFrame, issues: DataFrame, around: int = 1) -> DataFrame:
    """issues (doc, line) with ``code``: the numbered lines of lines (doc, line, text) up to ``around`` away.

    Each issue names the few lines it wants, so this is a join on equality.
    """
    wanted = issues.select("doc", F.col("line").alias("at")).distinct().withColumn("line", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - around), F.col("at") + around)))
    numbered = F.concat(F.col("line").cast("string"), F.lit(" "), F.col("text"))
    got = wanted.join(lines, ["doc", "line"]).groupBy("doc", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", numbered.alias("t")))), lambda s: s["t"]), "\n").alias("code"))
    return got.select("doc", F.col("at").alias("line"), "code")


def rank_at_least(value: Column, least: str) -> Column:
    """Whether a rank is at least another, UNDEFINED < LOW < MEDIUM < HIGH."""
    ranks = F.array(*map(F.lit, ("UNDEFINED", "LOW", "MEDIUM", "HIGH")))
    return F.array_position(ranks, value) >= F.array_position(ranks, F.lit(least))


def overwritten(ops: DataFrame) -> DataFrame:
    """(op, slot) of operations (op, ts, slot, mode): writes that the next operation on their slot overwrites before any read."""
    following = F.lead("mode").over(Window.partitionBy("slot").orderBy("ts", "op"))
    return ops.withColumn("next", following).filter("mode = 'write' and next = 'write'").select("op", "slot")
