"""Queries of points-to, lifetime, conditional values, shapes and small-group algorithms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import combinatorics, conditions, pointsto, shape
from ..shared import spread, written
from .base import EDGE, FLOW, edges, flow, led, lines, nodes, program, query, roots, table


def _text(c):
    return F.concat(F.lit("n"), F.col(c).cast("string"))


def _program(spark, sf_dir):
    """All lines as slots: each allocates itself; flows by their kinds are copies, loads and stores."""
    every, f = program(spark, sf_dir)
    f = written(f)
    own = every.select(_text("id").alias("slot"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("obj"))
    pick = lambda k: f.filter(F.col("kind") == k)
    copy = pick("1-URGENT").select(_text("src").alias("src"), _text("dst").alias("dst"))
    load = pick("2-HIGH").select(_text("dst").alias("dst"), _text("src").alias("base"), F.lit("f").alias("field"))
    store = pick("3-MEDIUM").select(_text("src").alias("base"), F.lit("f").alias("field"), _text("dst").alias("src"))
    return own, copy, load, store


_COPY = f"WITH RECURSIVE {FLOW}, copy AS (SELECT DISTINCT 'n' || src AS src, 'n' || dst AS dst FROM flow WHERE kind = '1-URGENT'), pts(slot, obj) AS (SELECT 'n' || id, 'o' || id FROM node UNION SELECT c.dst, p.obj FROM pts p JOIN copy c ON p.slot = c.src)"


@query("pts03", f"{_COPY} SELECT slot, obj FROM pts")
def assignments(spark, sf_dir):
    own, copy, _, _ = _program(spark, sf_dir)
    return pointsto.flow(own, copy)


@query("pts01")
def solver(spark, sf_dir):
    return pointsto.solve(*_program(spark, sf_dir))


@query("pts04", f"WITH {FLOW} SELECT 'n' || id AS slot, 'o' || id AS obj FROM node")
def allocations(spark, sf_dir):
    return _program(spark, sf_dir)[0]


@query("pts05", f"{_COPY} SELECT DISTINCT slot, true AS result FROM pts UNION ALL SELECT DISTINCT src, false FROM copy")
def null_checks(spark, sf_dir):
    own, copy, _, _ = _program(spark, sf_dir)
    pts = written(pointsto.flow(own, copy))
    return pointsto.checks(pts, copy.select(F.col("src").alias("slot")), pts.select("slot").distinct())


@query("pts06", f"{_COPY} SELECT DISTINCT 'site' || slot AS site, obj AS callee FROM pts")
def dispatch(spark, sf_dir):
    own, copy, _, _ = _program(spark, sf_dir)
    pts = written(pointsto.flow(own, copy))
    return pointsto.callees(pts, pts.select(F.concat(F.lit("site"), "slot").alias("site"), "slot").distinct())


@query("pts10", f"{_COPY} SELECT slot, list_sort(list(obj)) AS objects FROM pts GROUP BY slot")
def annotated(spark, sf_dir):
    own, copy, _, _ = _program(spark, sf_dir)
    return pointsto.flow(own, copy).groupBy("slot").agg(F.array_sort(F.collect_set("obj")).alias("objects"))


@query("pts11", f"WITH {FLOW} SELECT DISTINCT 'n' || f.src AS slot FROM flow f WHERE f.kind = '1-URGENT' AND f.src NOT IN (SELECT id FROM node WHERE top) AND NOT EXISTS (SELECT 1 FROM flow g WHERE g.kind = '1-URGENT' AND g.dst = f.src)")
def root_causes(spark, sf_dir):
    """Unresolved copies when only orders' first lines allocate."""
    own, copy, _, _ = _program(spark, sf_dir)
    few = own.join(roots(spark, sf_dir).select(_text("node").alias("slot")), "slot", "left_semi")
    return pointsto.unresolved(written(pointsto.flow(few, copy)), copy)


@query("ipa04", f"{_COPY} SELECT slot, count(*) AS objects FROM pts GROUP BY slot")
def copied(spark, sf_dir):
    own, copy, _, _ = _program(spark, sf_dir)
    return pointsto.flow(own, copy).groupBy("slot").agg(F.count("*").alias("objects"))


@query("ipa14", f"""{_COPY}, seed AS (SELECT 'n' || id AS slot, 1 AS flag FROM node WHERE bottom UNION ALL SELECT 'n' || id, 2 FROM node WHERE top UNION ALL SELECT 'n' || id, 4 FROM node WHERE region = 0),
f AS (SELECT DISTINCT p.obj AS outside, q.obj AS inside FROM flow s JOIN pts p ON p.slot = 'n' || s.src JOIN pts q ON q.slot = 'n' || s.dst WHERE s.kind = '3-MEDIUM'),
e(obj, flag) AS (SELECT obj, flag FROM pts JOIN seed ON pts.slot = seed.slot UNION SELECT f.inside, e.flag FROM e JOIN f ON f.outside = e.obj)
SELECT obj, bit_or(flag) AS flags FROM e GROUP BY obj""")
def escapes(spark, sf_dir):
    """Which objects leave their program: 1 through its last slot, 2 through its first, 4 through finished lines; what their fields hold goes along."""
    own, copy, _, store = _program(spark, sf_dir)
    every, pts = nodes(spark, sf_dir).withColumn("slot", _text("id")), written(pointsto.flow(own, copy))
    held = store.join(pts.select(F.col("slot").alias("base"), "obj"), "base").join(pts.select(F.col("slot").alias("src"), F.col("obj").alias("inner")), "src").select("obj", "inner").distinct()
    return pointsto.escape(pts, written(held), every.filter("bottom").select("slot"), every.filter("top").select("slot"), every.filter("region = 0").select("slot"))


@query("ipa05", f"WITH {FLOW} SELECT 'n' || dst AS slot, 'o' || src AS obj, 'DN' AS qualifier FROM flow WHERE kind = '4-NOT SPECIFIED'")
def downward(spark, sf_dir):
    """Objects handed to callees take the qualifier of what comes from above."""
    own = _program(spark, sf_dir)[0]
    invoke = flow(spark, sf_dir).filter("kind = '4-NOT SPECIFIED'").select(_text("src").alias("slot"), _text("dst").alias("to"))
    return own.join(invoke, "slot").select(F.col("to").alias("slot"), "obj", F.lit("DN").alias("qualifier"))


_KILL = f"WITH RECURSIVE {FLOW}, call AS (SELECT DISTINCT src, kind, dst FROM flow), facts(code, obj) AS (SELECT id, region FROM node UNION SELECT c.src, f.obj FROM facts f JOIN call c ON f.code = c.dst WHERE NOT (c.kind = '5-LOW' AND f.obj = 0))"


@query("lif05", f"{_KILL} SELECT code, obj FROM facts")
def read_modify(spark, sf_dir):
    """Reads pass from callees to callers; objects of the first region are killed on calls of low priority."""
    return _reads(spark, sf_dir)[0]


def _reads(spark, sf_dir):
    calls = written(flow(spark, sf_dir).select("src", F.col("kind").alias("op"), "dst"))
    facts = nodes(spark, sf_dir).select(F.col("id").alias("code"), F.col("region").alias("obj"))
    killed = calls.filter("op = '5-LOW'").select("src", "op", F.lit(0).alias("obj"))
    return pointsto.propagate(facts, calls, killed), calls


@query("joi02", f"{_KILL} SELECT DISTINCT f.code, c.kind AS op, f.obj FROM facts f JOIN call c ON f.code = c.src JOIN facts g ON g.code = c.dst AND g.obj = f.obj")
def propagated(spark, sf_dir):
    facts, calls = _reads(spark, sf_dir)
    facts = written(facts)
    below = facts.select(F.col("code").alias("dst"), "obj")
    return facts.join(calls, facts["code"] == calls["src"]).join(below, ["dst", "obj"]).select("code", "op", "obj").distinct()


@query("lif02", f"WITH RECURSIVE {EDGE}, seen(node) AS (SELECT id FROM node WHERE region = 0 UNION SELECT e.dst FROM seen s JOIN edge e ON s.node = e.src) SELECT node FROM seen")
def visible(spark, sf_dir):
    """What is visible from the existing objects: finished lines."""
    from ..operators import graph

    return graph.reach(edges(spark, sf_dir), nodes(spark, sf_dir).filter("region = 0").select(F.col("id").alias("node")))


@query("lif03", f"WITH RECURSIVE {EDGE}, held(src, dst) AS (SELECT src, dst FROM edge UNION SELECT h.src, e.dst FROM held h JOIN edge e ON h.dst = e.src) SELECT dst AS object, count(DISTINCT src) AS holders FROM held GROUP BY dst")
def holders(spark, sf_dir):
    from ..operators import graph

    return graph.closure(edges(spark, sf_dir), cycles=True).groupBy(F.col("dst").alias("object")).agg(F.count_distinct("src").alias("holders"))


@query("lif06", "SELECT DISTINCT l_suppkey AS code, l_partkey AS op, l_returnflag AS ctx, l_linestatus AS value FROM lineitem")
def database(spark, sf_dir):
    """The relation of code, operation, context and value that nested mappings hold."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_partkey").alias("op"), F.col("l_returnflag").alias("ctx"), F.col("l_linestatus").alias("value")).dropDuplicates()


def _trees(spark, sf_dir):
    """One tree for each part over its return flags: whether lines with the flag are open."""
    l = table(spark, sf_dir, "lineitem")
    flags = F.array(*map(F.lit, "ANR"))
    open_ = l.groupBy(F.col("l_partkey").alias("tree")).agg(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_returnflag"))).alias("open"))
    return open_.select("tree", "open", F.explode(flags).alias("flag")).select("tree", F.create_map(F.lit("flag"), "flag").alias("path"), F.array_contains("open", F.col("flag")).alias("value"))


_TREES = "trees AS (SELECT l_partkey AS tree, f AS flag, bool_or(l_linestatus = 'O' AND l_returnflag = f) AS value FROM lineitem, (VALUES ('A'), ('N'), ('R')) v(f) GROUP BY ALL)"


@query("cnd02", f"WITH {_TREES}, s AS (SELECT tree, count(DISTINCT value) AS d FROM trees GROUP BY tree) SELECT tree, d = 1 AS is_leaf, CASE WHEN d = 1 THEN 1 ELSE 3 END AS rows FROM s")
def canonical_trees(spark, sf_dir):
    c = conditions.collapse(_trees(spark, sf_dir), "flag", 3)
    return c.groupBy("tree").agg(F.max(F.size("path") == 0).alias("is_leaf"), F.count("*").alias("rows"))


@query("cnd03", f"WITH {_TREES} SELECT tree, flag, value AND flag <> 'A' AS value FROM trees")
def binary_lift(spark, sf_dir):
    t = _trees(spark, sf_dir)
    other = t.withColumn("value", F.element_at("path", F.lit("flag")) != "A")
    return conditions.lift(t, other, lambda a, b: a & b).select("tree", F.element_at("path", F.lit("flag")).alias("flag"), "value")


@query("cnd04", f"WITH {_TREES} SELECT tree, flag, CASE WHEN value THEN 'open ' || flag ELSE 'shut' END AS value FROM trees")
def if_then_else(spark, sf_dir):
    t = _trees(spark, sf_dir)
    yes = t.withColumn("value", F.concat(F.lit("open "), F.element_at("path", F.lit("flag"))))
    no = t.select("tree").distinct().select("tree", F.create_map().cast("map<string,string>").alias("path"), F.lit("shut").alias("value"))
    return conditions.if_then_else(t, yes, no).select("tree", F.element_at("path", F.lit("flag")).alias("flag"), "value")


@query("cnd05", f"WITH {_TREES} SELECT tree, value FROM trees WHERE flag = 'N'")
def restricted(spark, sf_dir):
    return conditions.restrict(_trees(spark, sf_dir), "flag", "N").select("tree", "value")


@query("cnd06", f"WITH {_TREES} SELECT tree, flag, CASE WHEN flag <> 'R' THEN value ELSE false END AS value FROM trees")
def simplified(spark, sf_dir):
    t = _trees(spark, sf_dir)
    domain = t.withColumn("value", F.element_at("path", F.lit("flag")) != "R")
    return conditions.simplify(t, domain, False).select("tree", F.element_at("path", F.lit("flag")).alias("flag"), "value")


@query("cnd07", f"WITH {_TREES} SELECT tree, bool_or(value) AS maybe_true, bool_or(NOT value) AS maybe_false FROM trees GROUP BY tree")
def bool_algebra(spark, sf_dir):
    return conditions.maybe_true(_trees(spark, sf_dir))


@query("cnd01", "SELECT DISTINCT l_returnflag AS value, 'flag' AS condition FROM lineitem")
def condition_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("value"), F.lit("flag").alias("condition")).distinct()


@query("shp07", "SELECT l_partkey AS obj, l_returnflag AS slot, CAST(least(count(*), 3) AS INTEGER) AS n FROM lineitem GROUP BY ALL")
def reference_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("obj"), F.col("l_returnflag").alias("slot")).agg(F.least(F.count("*"), F.lit(shape.MANY)).cast("int").alias("n"))


@query("shp05", "WITH c AS (SELECT l_partkey AS obj, CAST(least(count(*), 3) AS INTEGER) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) SELECT obj, unnest(CASE n WHEN 3 THEN [2, 3] WHEN 2 THEN [1] ELSE [0] END) AS n FROM c")
def forgotten(spark, sf_dir):
    """Counts after one reference from the slot N goes; many gives two cases."""
    c = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("obj")).agg(F.least(F.count("*"), F.lit(shape.MANY)).cast("int").alias("n"))
    after = F.explode(shape.decrement(F.create_map(F.lit("N"), "n"), F.lit("N"))).alias("m")
    return c.select("obj", after).select("obj", F.coalesce(F.element_at("m", F.lit("N")), F.lit(0)).alias("n"))


@query("srt05")
def increasing(spark, sf_dir):
    """A longest increasing run of prices over each customer's orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("v"))
    lis = F.pandas_udf(lambda v: v.map(lambda x: [float(y) for y in combinatorics.increasing(list(x))]), "array<double>")
    return o.select("k", lis("v").alias("run"))


@query("srt06")
def common(spark, sf_dir):
    """The longest common subsequence of each user's event types and those of the user before, as a length."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"]).alias("v"))
    both = e.join(e.select((F.col("user_id") + 1).alias("user_id"), F.col("v").alias("w")), "user_id")
    lcs = F.pandas_udf(lambda v, w: pd.Series([combinatorics.common(list(a), list(b)) for a, b in zip(v, w, strict=True)]), "long")
    return both.select("user_id", lcs("v", "w").alias("length"))


def _kinds(spark, sf_dir):
    """Each order's graph by its lines' numbers. Lines are dealt by order once, which serves all that follows."""
    l = lines(spread(table(spark, sf_dir, "lineitem").filter("l_orderkey is not null and l_linenumber is not null"), "l_orderkey"))
    return l.select(F.col("p").alias("kind"), "j", led()).select("kind", F.col("j").cast("long").alias("src"), F.col("to").cast("long").alias("dst"))


@query("gra15")
def articulation(spark, sf_dir):
    return combinatorics.per_graph(_kinds(spark, sf_dir), "kind", lambda g: [(n,) for n in sorted(combinatorics.cut_nodes(g))], "kind string, node long")


@query("gra17")
def matchings(spark, sf_dir):
    return combinatorics.per_graph(_kinds(spark, sf_dir).withColumn("dst", F.col("dst") + 1000), "kind", lambda g: sorted((l, r - 1000) for r, l in combinatorics.matching({k: v for k, v in g.items() if k < 1000}).items()), "kind string, src long, dst long")


@query("gra19")
def lexicographic(spark, sf_dir):
    return combinatorics.per_graph(_kinds(spark, sf_dir), "kind", lambda g: list(enumerate(combinatorics.lexicographic_order(g))), "kind string, position long, node long")


@query("gra21")
def colours(spark, sf_dir):
    return combinatorics.per_graph(_kinds(spark, sf_dir), "kind", lambda g: sorted(combinatorics.colouring(g).items()), "kind string, node long, colour long")


@query("set07", "SELECT user_id, bit_and(m) = 0 AS exclusive FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS m FROM events) GROUP BY user_id")
def exclusive(spark, sf_dir):
    """Whether no branch allows all of a user's events: the and of their branch masks is empty."""
    m = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.bit_and(m) == 0).alias("exclusive"))


@query("opt11", f"WITH RECURSIVE {EDGE}, live(node) AS (SELECT id FROM node WHERE top UNION SELECT e.dst FROM live l JOIN edge e ON l.node = e.src) SELECT id AS code FROM node WHERE id NOT IN (SELECT node FROM live)")
def culled(spark, sf_dir):
    from ..operators import graph

    live = graph.reach(edges(spark, sf_dir), roots(spark, sf_dir))
    return nodes(spark, sf_dir).select(F.col("id").alias("code")).join(live, F.col("code") == live["node"], "left_anti")


@query("opt05", "SELECT event_id AS load, src AS source FROM (SELECT event_id, event_type, max(CASE WHEN event_type IN ('view', 'purchase') THEN event_id END) OVER (PARTITION BY user_id, value ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM events) WHERE event_type = 'view' AND src IS NOT NULL")
def load_elimination(spark, sf_dir):
    """Loads (views) that an earlier load or store of the same signature (user and value) makes needless."""
    w = Window.partitionBy("user_id", "value").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").withColumn("source", F.max(F.when(F.col("event_type").isin("view", "purchase"), F.col("event_id"))).over(w))
    return e.filter("event_type = 'view' and source is not null").select(F.col("event_id").alias("load"), "source")


@query("opt07", "SELECT l_partkey AS expr, count(*) AS calls FROM lineitem GROUP BY l_partkey HAVING count(*) = count(CASE WHEN l_returnflag IN ('N', 'A') THEN 1 END)")
def method_fusion(spark, sf_dir):
    """Receivers whose every callee is in the known set."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("expr")).agg(F.count("*").alias("calls"), F.count_if(F.col("l_returnflag").isin("N", "A")).alias("n")).filter("calls = n and calls > 0").select("expr", "calls")


@query("opt09", "SELECT l_orderkey AS code, max(n) AS length FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey HAVING count(DISTINCT n) = 1")
def argument_normalisation(spark, sf_dir):
    """Functions whose extra arguments have one known length in every context."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("l_orderkey").alias("code")).agg(F.max("n").alias("length"), F.count_distinct("n").alias("d")).filter("d = 1").select("code", "length")


@query("opt12", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL")
def bool_conversions(spark, sf_dir):
    """Conversions whose operand is known to be a truth value already."""
    known = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return table(spark, sf_dir, "events").filter("value is not null").join(F.broadcast(known), "event_type", "left_semi").select("event_id")
