"""Queries of ordered, aggregate, set and scalar operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dataflow, lattice, order
from ..shared import written
from .base import FLOW, OPERATIONS, flow, in_order, operations, query, table, tree  # noqa: F401

_RAW = """SELECT src, op AS dst, CASE WHEN mode = 'read' THEN 'RAW' ELSE 'WAW' END AS kind FROM (
  SELECT *, last_value(CASE WHEN mode = 'write' THEN op END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY ts, op ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM ops) WHERE src IS NOT NULL"""


@query("win01", f"WITH {OPERATIONS} {_RAW}")
def last_writer(spark, sf_dir):
    return order.memory_dependences(operations(spark, sf_dir))


@query("ddg01", f"WITH {OPERATIONS} {_RAW} UNION ALL SELECT op, nxt, 'WAR' FROM (SELECT *, first_value(CASE WHEN mode = 'write' THEN op END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY ts, op ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ops) WHERE mode = 'read' AND nxt IS NOT NULL")
def data_dependences(spark, sf_dir):
    return order.memory_dependences(operations(spark, sf_dir), compat=False)


@query("ddg02", f"WITH {OPERATIONS}, d AS ({_RAW}) SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources FROM d GROUP BY ALL")
def dependence_kinds(spark, sf_dir):
    return order.memory_dependences(operations(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


@query("agg16", f"WITH {OPERATIONS}, d AS ({_RAW}) SELECT (SELECT count(*) FROM ops) AS ops, (SELECT count(DISTINCT slot) FROM ops) AS slots, (SELECT count(*) FROM ops) + (SELECT count(DISTINCT slot) FROM ops) AS nodes, (SELECT count(*) FROM d) AS edges")
def dependence_statistics(spark, sf_dir):
    ops = operations(spark, sf_dir)
    seen = ops.agg(F.count("*").alias("ops"), F.count_distinct("slot").alias("slots"))
    edges = order.memory_dependences(ops).agg(F.count("*").alias("edges"))
    return seen.withColumn("_", F.lit(1)).join(edges.withColumn("_", F.lit(1)), "_").select("ops", "slots", (F.col("ops") + F.col("slots")).alias("nodes"), "edges")  # one row each


@query("joi09", f"WITH {OPERATIONS}, d AS ({_RAW}) SELECT src, dst FROM d WHERE kind = 'RAW'")
def def_use(spark, sf_dir):
    return order.memory_dependences(operations(spark, sf_dir)).filter("kind = 'RAW'").select("src", "dst")


@query("win02", "SELECT o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sibling FROM orders")
def siblings(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.lead("o_orderkey").over(w).alias("sibling"))


_TRACE = "SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events"


@query("win04", _TRACE)
def trace(spark, sf_dir):
    return order.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "event_id", "event_type", "previous")


@query("agg24", f"SELECT user_id, count(DISTINCT (previous, event_type)) AS coverage FROM ({_TRACE}) GROUP BY user_id")
def coverage(spark, sf_dir):
    pair = F.struct(F.coalesce("previous", F.lit("")), "event_type")
    return order.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").groupBy("user_id").agg(F.count_distinct(pair).alias("coverage"))


@query("fuz04", f"SELECT previous, event_type, count(*) AS times, count(DISTINCT user_id) AS users FROM ({_TRACE}) WHERE previous IS NOT NULL GROUP BY ALL")
def coverage_trace(spark, sf_dir):
    return order.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").filter("previous is not null").groupBy("previous", "event_type").agg(F.count("*").alias("times"), F.count_distinct("user_id").alias("users"))


@query("win05", "SELECT l_partkey AS var, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS version FROM lineitem")
def ssa_versions(spark, sf_dir):
    return order.versions(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_shipdate", "l_orderkey", "l_linenumber").select(F.col("l_partkey").alias("var"), "l_orderkey", "l_linenumber", "version")


@query("win06", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS least FROM orders")
def minima(spark, sf_dir):
    return order.prefix_minima(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderdate", "o_orderkey").select("o_orderkey", "least")


@query("win07", "SELECT s.l_orderkey, s.lo, s.hi, min(l.l_extendedprice) AS least FROM (SELECT l_orderkey, (min(l_linenumber) + max(l_linenumber)) // 2 AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = count(*)) s JOIN lineitem l ON l.l_orderkey = s.l_orderkey AND l.l_linenumber >= s.lo AND l.l_linenumber < s.hi GROUP BY ALL")
def range_minima(spark, sf_dir):
    """The least price in the second half of each order's lines, its last line aside."""
    lines = table(spark, sf_dir, "lineitem")
    spans = lines.groupBy("l_orderkey").agg(F.floor((F.min("l_linenumber") + F.max("l_linenumber")) / 2).cast("int").alias("lo"), F.max("l_linenumber").alias("hi"), F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("m")).filter("n = m").select("l_orderkey", "lo", "hi")
    return order.range_minimum(lines, "l_orderkey", "l_linenumber", "l_extendedprice", spans)


@query("win08", "SELECT a.event_id AS assign, min(b.event_id) AS first_call, count(b.event_id) AS calls FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id) WHERE a.event_type = 'signup' GROUP BY a.event_id")
def later_statements(spark, sf_dir):
    """For each signup the purchases of the same user after it: suffix aggregates, so no pairs are made."""
    later = in_order("user_id").rowsBetween(1, Window.unboundedFollowing)
    buy = F.when(F.col("event_type") == "purchase", F.col("op"))
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "op")
    return e.withColumns({"first_call": F.min(buy).over(later), "calls": F.count(buy).over(later)}).filter("event_type = 'signup' and calls > 0").select(F.col("op").alias("assign"), "first_call", "calls")


@query("win09", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS post FROM orders")
def predicted_order(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("post"))


_CLASSES = "SELECT c_mktsegment AS cls, o_orderpriority AS op, o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey"


def _classes(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("cls"), F.col("o_orderpriority").alias("op"), "o_orderkey", "c_custkey")


@query("agg01", f"WITH t AS ({_CLASSES}), n AS (SELECT cls, c_custkey, count(*) AS contexts FROM t GROUP BY ALL) SELECT cls, least(contexts, 16) AS bucket, count(*) AS codes, sum(contexts)::BIGINT AS contexts FROM n GROUP BY ALL")
def statistics(spark, sf_dir):
    n = _classes(spark, sf_dir).groupBy("cls", "c_custkey").agg(F.count("*").alias("contexts"))
    return n.groupBy("cls", F.least(F.col("contexts"), F.lit(16)).alias("bucket")).agg(F.count("*").alias("codes"), F.sum("contexts").alias("contexts"))


@query("agg02", f"WITH t AS ({_CLASSES}), n AS (SELECT cls, c_custkey, count(*) AS k FROM t GROUP BY ALL), r AS (SELECT cls, count(*) AS codes, sum(k)::BIGINT AS contexts FROM n GROUP BY ROLLUP (cls)), w AS (SELECT codes AS ac, contexts AS ax FROM r WHERE cls IS NULL) SELECT coalesce(cls, 'total') AS cls, codes, round(100.0 * codes / ac, 6) AS codes_percent, contexts, round(100.0 * contexts / ax, 6) AS contexts_percent, round(contexts * 1.0 / codes, 6) AS per_code FROM r, w")
def function_ratios(spark, sf_dir):
    n = _classes(spark, sf_dir).groupBy("cls", "c_custkey").agg(F.count("*").alias("k"))
    r = n.rollup("cls").agg(F.count("*").alias("codes"), F.sum("k").alias("contexts"))
    whole = Window.partitionBy(F.lit(0))  # a row for each class
    return r.withColumns({"ac": F.max("codes").over(whole), "ax": F.max("contexts").over(whole)}).select(
        F.coalesce("cls", F.lit("total")).alias("cls"), "codes", F.round(100.0 * F.col("codes") / F.col("ac"), 6).alias("codes_percent"), "contexts",
        F.round(100.0 * F.col("contexts") / F.col("ax"), 6).alias("contexts_percent"), F.round(F.try_divide(F.col("contexts") * 1.0, F.col("codes")), 6).alias("per_code"),
    )


@query("agg03", f"WITH t AS ({_CLASSES}), r AS (SELECT cls, op, count(*) AS n FROM t GROUP BY ROLLUP (cls, op)) SELECT coalesce(cls, 'total') AS cls, coalesce(op, 'total') AS op, n, round(100.0 * n / (SELECT n FROM r WHERE cls IS NULL), 6) AS percent FROM r")
def op_ratios(spark, sf_dir):
    r = _classes(spark, sf_dir).rollup("cls", "op").agg(F.count("*").alias("n"))
    return r.withColumn("all", F.max("n").over(Window.partitionBy(F.lit(0)))).select(F.coalesce("cls", F.lit("total")).alias("cls"), F.coalesce("op", F.lit("total")).alias("op"), "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("percent"))


@query("agg04", "WITH a AS (SELECT o_orderpriority AS op, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_orderpriority AS op, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT coalesce(a.op, b.op) AS op, coalesce(a.n, 0) AS old, coalesce(b.n, 0) AS new, round(CASE WHEN coalesce(a.n, 0) = 0 THEN 0.0 ELSE 100.0 * (a.n - coalesce(b.n, 0)) / a.n END, 6) AS removed FROM a FULL JOIN b ON a.op = b.op")
def ops_removed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.groupBy(F.col("o_orderpriority").alias("op")).agg(F.count("*").alias("old"))
    b = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("op")).agg(F.count("*").alias("new"))
    both = a.join(b, "op", "full").fillna(0, ["old", "new"]).filter("old > 0 or new > 0")
    return both.withColumn("removed", F.round(F.when(F.col("old") == 0, 0.0).otherwise(100.0 * (F.col("old") - F.col("new")) / F.col("old")), 6))


@query("agg05", f"WITH t AS ({_CLASSES}) SELECT op, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY op")
def op_pie(spark, sf_dir):
    r = _classes(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"))
    return r.withColumn("share", F.round(F.col("n") * 1.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("agg06", "WITH a AS (SELECT l_shipmode AS kind, l_orderkey, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode, l_orderkey FROM lineitem) GROUP BY ALL), b AS (SELECT kind, round(avg(n), 6) AS weight, count(*) AS contexts FROM a GROUP BY kind) SELECT kind, weight, contexts, round(avg(weight) OVER (), 6) AS mean FROM b")
def access_weights(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), "l_orderkey").agg(F.count("*").alias("n"))
    b = a.groupBy("kind").agg(F.round(F.avg("n"), 6).alias("weight"), F.count("*").alias("contexts"))
    return b.withColumn("mean", F.round(F.avg("weight").over(Window.partitionBy(F.lit(0))), 6))


@query("agg07", "SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS elements FROM lineitem GROUP BY ALL")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(lattice.union_of_elements(F.concat("l_returnflag", "l_linestatus")).alias("elements"))


_INTER = "WITH p AS (SELECT DISTINCT o_custkey AS k, o_orderkey AS s, l_returnflag AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT k, count(DISTINCT s) AS n FROM p GROUP BY k), c AS (SELECT k, e, count(*) AS m FROM p GROUP BY ALL) SELECT n.k, list_sort(list(c.e)) AS elements FROM n LEFT JOIN c ON n.k = c.k AND c.m = n.n GROUP BY n.k"


def _customer_flags(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("s"), F.col("l_returnflag").alias("e"))


@query("agg08", _INTER.replace("list_sort(list(c.e)) AS elements", "CASE WHEN count(c.e) > 0 THEN list_sort(list(c.e)) END AS elements"))
def set_intersection(spark, sf_dir):
    """Return flags that every order of a customer has."""
    return lattice.intersection(_customer_flags(spark, sf_dir), ["k"], "s", "e")


@query("agg09", "SELECT o_custkey AS k, list_sort(list_distinct(list(l_returnflag))) AS elements FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def forget(spark, sf_dir):
    """The mapping (customer, order) -> flags with the order forgotten."""
    return _customer_flags(spark, sf_dir).groupBy("k").agg(lattice.union_of_elements("e").alias("elements"))


@query("agg10", "SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag))) AS a, list_sort(list_distinct(list(l_linestatus))) AS b, count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1 AS changed FROM lineitem GROUP BY ALL")
def structure_merge(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(lattice.union_of_elements("l_returnflag").alias("a"), lattice.union_of_elements("l_linestatus").alias("b")).withColumn("changed", (F.size("a") > 1) | (F.size("b") > 1))


@query("agg11", "SELECT l_suppkey AS op, l_returnflag AS ctx, list_sort(list_distinct(list(l_linestatus))) AS elements FROM lineitem GROUP BY GROUPING SETS ((l_suppkey), (l_suppkey, l_returnflag))")
def contextual(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("op"), F.col("l_returnflag").alias("ctx"), "l_linestatus")
    return l.groupingSets([[F.col("op")], [F.col("op"), F.col("ctx")]], F.col("op"), F.col("ctx")).agg(lattice.union_of_elements("l_linestatus").alias("elements"))


@query("agg12", "SELECT user_id AS k, bit_or(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 4 ELSE 0 END) AS flags FROM events GROUP BY ALL")
def flags(spark, sf_dir):
    flag = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 4).otherwise(0)
    return lattice.escape_flags(table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), flag.alias("f")), "k", "f")


@query("agg17", "SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation GROUP BY ALL")
def groupings(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("members"))


@query("agg18", "SELECT p_type AS grp, count(DISTINCT p_partkey) AS objects FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY ALL")
def live_heap(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").groupBy(F.col("p_type").alias("grp")).agg(F.count_distinct("p_partkey").alias("objects"))


@query("agg19", "SELECT CASE WHEN s IS NULL THEN -1 ELSE n END AS held_by, count(*) AS objects FROM (SELECT p_partkey, count(DISTINCT l_suppkey) AS n, max(l_suppkey) AS s FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL) GROUP BY ALL")
def held_histogram(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("n"))
    return table(spark, sf_dir, "part").join(held, "p_partkey", "left").groupBy(F.coalesce("n", F.lit(-1)).cast("long").alias("held_by")).agg(F.count("*").alias("objects"))


@query("agg20", _INTER.split(" SELECT n.k")[0] + " SELECT n.k AS ctx, c.e AS killed FROM n JOIN c ON n.k = c.k AND c.m = n.n")
def killed_everywhere(spark, sf_dir):
    """Relational division: flags killed on every incoming edge (order) of a context (customer)."""
    return lattice.intersection(_customer_flags(spark, sf_dir), ["k"], "s", "e").select(F.col("k").alias("ctx"), F.explode("elements").alias("killed"))


@query("agg21", "SELECT l_suppkey AS target, count(DISTINCT l_orderkey) AS invocations, count(*) AS ops FROM lineitem GROUP BY ALL")
def inline_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("target")).agg(F.count_distinct("l_orderkey").alias("invocations"), F.count("*").alias("ops"))


@query("agg22", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN printf('%.2f B', floor(o_totalprice * 100) / 100) WHEN o_totalprice < 1000000 THEN printf('%.2f kB', floor(o_totalprice / 10) / 100) ELSE printf('%.2f MB', floor(o_totalprice / 10000) / 100) END AS shown FROM orders")
def human_units(spark, sf_dir):
    p = F.col("o_totalprice")
    shown = F.when(p < 1000, F.format_string("%.2f B", F.floor(p * 100) / 100)).when(p < 1_000_000, F.format_string("%.2f kB", F.floor(p / 10) / 100)).otherwise(F.format_string("%.2f MB", F.floor(p / 10_000) / 100))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))


@query("agg23", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cubes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


_TVL = "SELECT doc_id, quality = 1 AS l, toxic = 1 AS r FROM (SELECT d.doc_id, l.quality, CASE WHEN l.quality = 1 THEN l.toxic END AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("flt03", f"SELECT l, r, NOT l AS not_l, l AND r AS and_lr, l OR r AS or_lr, l <> r AS xor_lr, l IS TRUE AS l_must, l IS FALSE AS l_must_not, l IS NOT FALSE AS l_maybe_true, l IS NOT TRUE AS l_maybe_false, l IS NOT NULL AS l_certain, count(*) AS n FROM ({_TVL}) GROUP BY ALL")
def three_valued(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    t = joined.select((F.col("quality") == 1).alias("l"), F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("r")).groupBy("l", "r").agg(F.count("*").alias("n"))
    return t.withColumns(lattice.both_ways(F.col("l"), F.col("r")))


@query("flt04", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def live_fields(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.filter("l_returnflag = 'N'").join(l.filter("l_returnflag = 'R'").select("l_partkey").distinct(), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("flt06", "SELECT p_partkey AS op, coalesce(n > 0, true) AS may FROM part LEFT JOIN (SELECT l_partkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n FROM lineitem GROUP BY ALL) ON p_partkey = l_partkey")
def side_effects(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    return table(spark, sf_dir, "part").join(n, "p_partkey", "left").select(F.col("p_partkey").alias("op"), F.coalesce(F.col("n") > 0, F.lit(True)).alias("may"))


@query("flt07", "SELECT o_custkey AS op FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def single_object(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("op")).agg(F.count_distinct("o_orderstatus").alias("n")).filter("n = 1").select("op")


@query("flt11", "SELECT o_orderkey AS ctx FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def cull(spark, sf_dir):
    live = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(live, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("ctx"))


@query("flt13", "SELECT event_id, CASE WHEN props IS NULL THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) IN (1, 2, 3) END AS hit FROM events")
def argument_value(spark, sf_dir):
    """Membership of an argument; null where the call has none."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").isin(1, 2, 3).alias("hit"))


@query("flt14", "SELECT p_partkey FROM part WHERE p_type LIKE 'PROMO%' OR p_brand = 'Brand#11' OR p_type LIKE '%E'")
def globs(spark, sf_dir):
    from ..functions.names import glob_match

    p = table(spark, sf_dir, "part")
    return p.filter(glob_match("p_type", "PROMO*") | glob_match("p_brand", "Brand#11") | glob_match("p_type", "*E")).select("p_partkey")


@query("flt15", "SELECT l_returnflag AS kind, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def wildcards(spark, sf_dir):
    """A key with a null component stands for any: null-safe equality joins keys with their wildcards."""
    keys = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))
    same = keys.select(F.col("kind").alias("k2"), F.col("status").alias("s2"))
    return keys.join(same, F.col("kind").eqNullSafe(F.col("k2")) & F.col("status").eqNullSafe(F.col("s2"))).select("kind", F.coalesce("status", F.lit("*")).alias("status"), "n")


@query("joi01", "SELECT l_suppkey AS dst, l_partkey AS dctx, l_orderkey AS code, l_linenumber AS op FROM lineitem")
def inverted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("dctx"), F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("op"))


@query("joi08", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)")
def baseline(spark, sf_dir):
    """Texts not in the baseline of earlier documents: by the least id of each text, so no pairs are made."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("joi11", "SELECT 'caller' AS side, s_nationkey AS node, count(DISTINCT c_nationkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL UNION ALL SELECT 'callee', c_nationkey, count(DISTINCT s_nationkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def callers_callees(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    pairs = (
        t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("c_nationkey", "s_nationkey").distinct()
    )
    return pairs.groupBy(F.lit("caller").alias("side"), F.col("s_nationkey").alias("node")).agg(F.count("*").alias("n")).union(pairs.groupBy(F.lit("callee"), "c_nationkey").agg(F.count("*")))


@query("joi17", "SELECT DISTINCT l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def issue_key(spark, sf_dir):
    keys = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return table(spark, sf_dir, "lineitem").select(*keys).dropDuplicates(keys)


@query("set01", "SELECT l_orderkey AS k, l_returnflag AS e, 'union' AS part FROM lineitem WHERE l_linestatus = 'O' UNION SELECT l_orderkey, l_returnflag, 'union' FROM lineitem WHERE l_linestatus = 'F' UNION ALL (SELECT l_orderkey, l_returnflag, 'less' FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_orderkey, l_returnflag, 'less' FROM lineitem WHERE l_linestatus = 'F')")
def set_algebra(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("e"), "l_linestatus")
    a, b = l.filter("l_linestatus = 'O'").drop("l_linestatus"), l.filter("l_linestatus = 'F'").drop("l_linestatus")
    return a.union(b).distinct().withColumn("part", F.lit("union")).union(a.subtract(b).withColumn("part", F.lit("less")))


@query("set02", "WITH s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(CASE WHEN l_linestatus = 'O' THEN l_returnflag END))) AS a, list_sort(list_distinct(list(CASE WHEN l_linestatus = 'F' THEN l_returnflag END))) AS b FROM lineitem GROUP BY ALL) SELECT k, list_sort(list_intersect(a, b)) AS both, list_sort([x FOR x IN a IF NOT list_contains(b, x)]) AS less FROM (SELECT k, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)")
def canonical_sets(spark, sf_dir):
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == s, F.col("l_returnflag"))))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(side("O").alias("a"), side("F").alias("b"))
    return s.select("k", F.array_sort(F.array_intersect("a", "b")).alias("both"), F.array_sort(F.array_except("a", "b")).alias("less"))


@query("set03", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def tuple_sets(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    return l.select("a", "b").dropDuplicates().join(l.filter("l_returnflag = 'R'").select("a", "b"), ["a", "b"], "left_anti")


@query("set08", "SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def escape_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'error'").select("user_id").union(e.filter("event_type = 'signup'").select("user_id")).distinct()


@query("srt01", f"WITH {FLOW} SELECT src, list_sort(list_distinct(list(dst))) AS dsts FROM flow GROUP BY src ORDER BY src")
def sorted_output(spark, sf_dir):
    return flow(spark, sf_dir).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dsts")).orderBy("src")


@query("srt04", "SELECT event_type, arg_max(user_id, n * 1000000000 - user_id) AS root, max(n) AS weight FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def heaviest_root(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("root"), F.max("n").alias("weight"))


@query("srt08", "SELECT doc_id, line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE line <= 3")
def excerpt_limit(spark, sf_dir):
    """At most three lines of each document: the limit is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n", -1), 1, 3)).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "text")


@query("ipa09", "WITH k AS (SELECT DISTINCT l_partkey AS node, CAST(l_suppkey AS VARCHAR) AS kind FROM lineitem), n AS (SELECT node, count(*) AS n FROM k GROUP BY node) SELECT k.node, k.kind FROM k JOIN n ON k.node = n.node WHERE n <= 4 UNION ALL SELECT node, 'any' FROM n WHERE n > 4")
def type_split(spark, sf_dir):
    """Suppliers of each part as its types; a fifth type makes it 'any'."""
    return lattice.widened(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "node"), "node", "l_suppkey")


@query("opt06", f"WITH {OPERATIONS}, n AS (SELECT *, lead(mode) OVER (PARTITION BY slot ORDER BY ts, op) AS next FROM ops) SELECT op, slot FROM n WHERE mode = 'write' AND next = 'write'")
def dead_stores(spark, sf_dir):
    """Writes of slots (users) that the next operation on the slot overwrites unread; a slot's last write may be read later."""
    return order.overwritten(operations(spark, sf_dir))


@query("opt01", f"""WITH RECURSIVE {FLOW}, own AS (SELECT DISTINCT src, weight FROM flow WHERE kind < '3'),
came(node, value) AS (SELECT f.dst, own.weight FROM own JOIN flow f ON f.src = own.src UNION SELECT f.dst, c.value FROM came c JOIN flow f ON f.src = c.node WHERE f.kind >= '3')
SELECT node, min(value) AS value FROM came GROUP BY node HAVING count(DISTINCT value) = 1""")
def constants(spark, sf_dir):
    """Where a variable has one value only: lines of flag N assign their quantity, others pass on what comes, loops included."""
    f = written(flow(spark, sf_dir))
    return dataflow.constants(f.select("src", "dst").distinct(), f.filter("kind < '3'").select(F.col("src").alias("node"), F.col("weight").alias("value")).distinct())


@query("opt14", "SELECT e.event_id, coalesce(r.new, e.event_type) AS node FROM events e LEFT JOIN (VALUES ('view', 'read'), ('click', 'read'), ('purchase', 'write')) r(old, new) ON e.event_type = r.old")
def rewrite(spark, sf_dir):
    new = F.create_map(*map(F.lit, ("view", "read", "click", "read", "purchase", "write")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.element_at(new, F.col("event_type")), "event_type").alias("node"))
