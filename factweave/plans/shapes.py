"""Shape analysis over orders as objects: their lines refer to them through fields (return flags) and locals (line states)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, shape
from .base import query, table


def configurations(spark, sf_dir):
    """(obj, counts, radius): for each order how many lines of each return flag refer to it, and the states of lines without discount."""
    l = table(spark, sf_dir, "lineitem")
    counts = l.groupBy("l_orderkey", "l_returnflag").agg(F.least(F.count("*"), F.lit(shape.MANY)).cast("int").alias("n"), F.collect_set(F.when(F.col("l_discount") == 0, F.col("l_linestatus"))).alias("r"))
    each = counts.groupBy(F.col("l_orderkey").alias("obj")).agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("counts"), F.flatten(F.collect_list("r")).alias("radius"))
    return each.select("obj", "counts", F.array_sort(F.array_distinct("radius")).alias("radius"))


_COUNTS = "c AS (SELECT l_orderkey AS obj, CAST(least(count(*) FILTER (WHERE l_returnflag = 'N'), 3) AS INTEGER) AS n, CAST(least(count(*) FILTER (WHERE l_returnflag = 'R'), 3) AS INTEGER) AS r, count(*) FILTER (WHERE l_returnflag <> 'N') > 0 OR bool_or(l_discount = 0) AS others FROM lineitem GROUP BY l_orderkey)"


@query("shp04", f"WITH {_COUNTS} SELECT obj, k AS n, CASE WHEN k > 0 THEN 'F.N' ELSE '' END AS misses FROM (SELECT *, unnest(CASE n WHEN 0 THEN [0] WHEN 1 THEN [1, 0] WHEN 2 THEN [2, 1] ELSE [3, 2, 3] END) AS k FROM c) WHERE k > 0 OR others")
def assigned(spark, sf_dir):
    """The configurations of all orders after ``F.N = None``, which may or may not refer to them."""
    none = F.array().cast("array<string>")
    configs = configurations(spark, sf_dir).select("*", none.alias("hits"), none.alias("misses"), F.lit("F.N").alias("target"), F.lit(None).cast("string").alias("value"))
    out = shape.assign(configs, "target", "value")
    return out.select("obj", F.coalesce(F.element_at("counts", F.lit("N")), F.lit(0)).alias("n"), F.array_join("misses", ",").alias("misses"))


@query("shp06", f"""WITH {_COUNTS}, s AS (SELECT c.*, o_orderpriority AS brand FROM c JOIN orders ON obj = o_orderkey),
v AS (SELECT o_orderpriority AS brand, o_orderpriority < '3' AS sees FROM orders GROUP BY o_orderpriority)
SELECT obj, CAST(least(n + 1, 3) AS INTEGER) AS n, r, count(*) OVER (PARTITION BY s.brand, n, CASE WHEN sees THEN r ELSE -1 END) AS sharing FROM s JOIN v ON s.brand = v.brand""")
def called(spark, sf_dir):
    """Each order's counts after a call of its priority, which sees field N, and R if it is high, and stores the order once more in N; and how many states left for the same configuration of the callee."""
    orders = table(spark, sf_dir, "orders")
    states = configurations(spark, sf_dir).join(orders.select(F.col("o_orderkey").alias("obj"), F.col("o_orderpriority").alias("call")), "obj").select(F.col("obj").alias("state"), "call", "counts", "radius")
    sees = orders.select(F.col("o_orderpriority").alias("call")).distinct().withColumn("sees", F.col("call") < "3")
    visible = sees.select("call", F.explode(F.when(F.col("sees"), F.array(F.lit("N"), F.lit("R"))).otherwise(F.array(F.lit("N")))).alias("slot"))
    local, remote = shape.split(states, visible)
    back = remote.withColumn("counts", shape.increment(F.col("counts"), F.lit("N")))
    sharing = local.groupBy("call", "key").agg(F.count("*").alias("sharing"))
    n = lambda f: F.coalesce(F.element_at("counts", F.lit(f)), F.lit(0))
    return shape.merge(local, back).select(F.col("state").alias("obj"), n("N").alias("n"), n("R").alias("r")).join(local.join(sharing, ["call", "key"]).select(F.col("state").alias("obj"), "sharing"), "obj")


@query("shp08", """WITH c AS (SELECT l_suppkey AS p, l_returnflag AS s, CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS path, count(*) AS class, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) = 'F' END AS hit FROM lineitem GROUP BY ALL),
n AS (SELECT p, count(DISTINCT s) AS n FROM c GROUP BY p),
k AS (SELECT p, path, list((s, class) ORDER BY s) AS parts, count(*) AS known, CASE WHEN count(hit) = count(*) AND min(hit) = max(hit) THEN min(hit) END AS hit FROM c GROUP BY p, path)
SELECT k.p AS point, min(path) OVER (PARTITION BY k.p, parts) AS class, path, CASE WHEN hit THEN 'yes' WHEN NOT hit THEN 'no' ELSE 'maybe' END AS hit FROM k JOIN n ON k.p = n.p WHERE known = n""")
def met(spark, sf_dir):
    """Which discounts a supplier's return flags agree on: each flag puts those with equally many lines in one class, all flags' partitions are intersected."""
    l = table(spark, sf_dir, "lineitem")
    path = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    hit = F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus") == "F")
    c = l.groupBy(F.col("l_suppkey").alias("point"), F.col("l_returnflag").alias("s"), path.alias("path")).agg(F.count("*").alias("class"), hit.alias("hit"))
    c = c.withColumn("state", F.concat_ws("/", "point", "s"))
    out = shape.meet(c.select("state", "path", "class", "hit"), c.select("point", "state"))
    return out.withColumn("hit", F.when(F.col("hit"), "yes").when(~F.col("hit"), "no").otherwise("maybe"))


@query("shp02", """WITH RECURSIVE r(slot, region) AS (SELECT DISTINCT l_partkey, l_partkey FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS slot FROM lineitem),
e AS (SELECT DISTINCT x.slot AS a, y.slot AS b FROM b x JOIN b y ON x.o = y.o), w(slot, b) AS (SELECT (SELECT min(l_partkey) FROM lineitem), (SELECT min(l_partkey) FROM lineitem) UNION SELECT w.slot, e.b FROM w JOIN e ON e.a = w.b)
SELECT l_partkey AS slot, CASE WHEN l_partkey IN (SELECT b FROM w) THEN (SELECT min(l_partkey) FROM lineitem) ELSE -1 END AS region FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
def regions(spark, sf_dir):
    """Slots (parts) that one operation (order) reads are one region; named are the slots of the least slot's region, the others have -1."""
    slots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("node"))
    read = slots.filter("o is not null").select("node", F.min("node").over(Window.partitionBy("o")).alias("least"))
    e = read.filter("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst"))
    found = graph.components(e, slots.select("node").distinct())
    first = slots.agg(F.min("node").alias("one"))
    return found.join(F.broadcast(first), found["component"] == first["one"], "left").select(F.col("node").alias("slot"), F.coalesce("one", F.lit(-1)).alias("region"))
