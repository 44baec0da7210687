"""Analyses between functions over programs that orders describe: each line is a function, the next one its callee.

A function is named ``order.line``; flags say what a line's function does with its parameters.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alike, interproc, storegraph
from ..shared import written
from .base import query, table

_LINES = """l AS (SELECT l_orderkey AS p, l_linenumber AS j, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY ALL),
line AS (SELECT *, lead(j) OVER (PARTITION BY p ORDER BY j) AS next, min(j) OVER (PARTITION BY p) AS first, max(j) OVER (PARTITION BY p) AS last FROM l)"""


def lines(spark, sf_dir):
    """(members, lines): orders with the first one of equal lines (p, like), and these first ones' lines (p, j, flag, status, next,
    first, last), with the numbers of the next, first and last one."""
    dealt = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_linenumber").alias("j"), "l_returnflag", "l_linestatus").repartition("p")
    members, one = alike.classes(dealt.groupBy("p", "j").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status")), "p", "j", "flag", "status")
    whole = Window.partitionBy("p")
    return members, written(one.select("*", F.lead("j").over(whole.orderBy("j")).alias("next"), F.min("j").over(whole).alias("first"), F.max("j").over(whole).alias("last")))


def _for_all(found, members, *names):
    """Rows found for the first orders, for all members: names that begin with an order, after letters or signs, get each member's number."""
    own = found.withColumn("p", F.regexp_extract(names[0], r"^[^0-9-]*(-?[0-9]+)", 1).cast("long"))
    rows = alike.given(own, members, "p")
    kept = [F.regexp_replace(c, r"^([^0-9-]*)-?[0-9]+", F.concat(F.lit("$1"), F.col("p").cast("string"))).alias(c) if c in names else F.col(c) for c in found.columns]
    return rows.select(kept)


def _fn(j: str):
    return F.concat_ws(".", "p", j)


def _slot(j: str, name: str):
    return F.concat_ws(".", "p", j, F.lit(name))


def _formals(l):
    return l.select(_fn("j").alias("fn"), F.explode(F.array(*(F.struct(F.lit(k).alias("pos"), _slot("j", n).alias("slot")) for n, k in (("a", 0), ("b", 1), ("r", -1))))).alias("f")).select("fn", "f.*")


@query("ipa03", f"""WITH RECURSIVE {_LINES},
e AS (SELECT p, j, 0 AS x, next AS k, CASE flag WHEN 'R' THEN 1 ELSE 0 END AS y FROM line WHERE next IS NOT NULL
  UNION SELECT p, j, 1, next, CASE flag WHEN 'R' THEN 0 ELSE 1 END FROM line WHERE next IS NOT NULL AND flag <> 'A'
  UNION SELECT p, j, 1, first, 0 FROM line WHERE status = 'F'),
r(p, j, x) AS (SELECT p, j, 0 FROM line WHERE j = last UNION SELECT e.p, e.j, e.x FROM r JOIN e ON e.p = r.p AND e.k = r.j AND e.y = r.x)
SELECT p || '.' || j AS fn, x AS i, -1 AS o FROM r""")
def summaries(spark, sf_dir):
    """Which parameters reach a function's result: it calls the next one with both, turned round or the first alone, some call the first one again, and the last one returns its first."""
    members, l = lines(spark, sf_dir)
    inner = l.filter("next is not null")
    site = lambda n: F.concat_ws("/", _fn("j"), F.lit(n))
    calls = inner.select(_fn("j").alias("fn"), site(0).alias("site"), _fn("next").alias("target")).union(l.filter("status = 'F'").select(_fn("j"), site(1), _fn("first")))
    pair = lambda frame, n, pos, name: frame.select(site(n).alias("site"), F.lit(pos).alias("pos"), _slot("j", name).alias("slot"))
    actuals = pair(inner.filter("flag = 'R'"), 0, 1, "a").union(pair(inner.filter("flag = 'R'"), 0, 0, "b")).union(pair(inner.filter("flag <> 'R'"), 0, 0, "a")).union(pair(inner.filter("flag = 'N'"), 0, 1, "b"))
    actuals = actuals.union(pair(inner, 0, -1, "r")).union(pair(l.filter("status = 'F'"), 1, 0, "b")).union(pair(l.filter("status = 'F'"), 1, -1, "r"))
    flows = l.filter("j = last").select(_fn("j").alias("fn"), _slot("j", "a").alias("src"), _slot("j", "r").alias("dst"))
    return _for_all(interproc.summaries(flows, calls, actuals, _formals(l)), members, "fn")


@query("ipa02", f"""WITH RECURSIVE {_LINES},
s(p, j, v) AS (SELECT p, first, last FROM line WHERE j = first
  UNION SELECT s.p, CASE flag WHEN 'R' THEN s.v ELSE next END, CASE flag WHEN 'A' THEN s.v ELSE coalesce(next, 0) END
    FROM s JOIN line ON line.p = s.p AND line.j = s.j WHERE CASE flag WHEN 'R' THEN s.v > 0 ELSE next IS NOT NULL END)
SELECT DISTINCT s.p || '.' || s.j AS fn, s.p || '.' || CASE flag WHEN 'R' THEN s.v ELSE next END AS target
FROM s JOIN line ON line.p = s.p AND line.j = s.j WHERE CASE flag WHEN 'R' THEN s.v > 0 ELSE next IS NOT NULL END""")
def growth(spark, sf_dir):
    """The call graph from each order's first function, which gets the last one: R calls what it got with the next one, A the next one with what it got, N the next one with itself."""
    members, l = lines(spark, sf_dir)
    refs = l.filter("next is not null").select(_fn("j").alias("fn"), _slot("j", "n").alias("slot"), _fn("next").alias("target"))
    first = l.filter("j = first")
    refs = refs.union(first.select(_fn("j"), _slot("j", "a"), _fn("last")))
    by = F.when(F.col("flag") == "R", _slot("j", "a")).otherwise(_slot("j", "n"))
    calls = l.select(_fn("j").alias("fn"), F.concat_ws("/", _fn("j"), F.lit("0")).alias("site"), by.alias("slot"))
    given = F.when(F.col("flag") == "A", _slot("j", "a")).otherwise(_slot("j", "n"))
    actuals = l.select(F.concat_ws("/", _fn("j"), F.lit("0")).alias("site"), F.lit(0).alias("pos"), given.alias("slot"))
    flows = l.filter("false").select(_fn("j").alias("fn"), _slot("j", "a").alias("src"), _slot("j", "a").alias("dst"))
    edges = interproc.top_down(flows, refs, calls, actuals, _formals(l), first.select(_fn("j").alias("fn")))[1]
    return _for_all(edges.select("fn", "target"), members, "fn", "target")


def heap(spark, sf_dir):
    """Members of equal orders, and (allocs, copies, loads, stores) of the first ones: a slot for each line; N allocates, R copies to the next one, A stores the next one in a field, F also loads the field into the next one."""
    members, l = lines(spark, sf_dir)
    v, w = _slot("j", "v"), _slot("next", "v")
    allocs = l.filter("flag = 'N' or j = first").select(v.alias("slot"), F.concat(F.lit("o"), _fn("j")).alias("obj"))
    inner = l.filter("next is not null")
    copies = inner.filter("flag = 'R'").select(v.alias("src"), w.alias("dst"))
    loads = inner.filter("status = 'F'").select(v.alias("base"), F.lit("f").alias("field"), w.alias("dst"))
    stores = inner.filter("flag = 'A'").select(v.alias("base"), F.lit("f").alias("field"), w.alias("src"))
    return members, (allocs, copies, loads, stores)


@query("pts14")
def store_graph(spark, sf_dir):
    """What the slots and field slots of each order's program hold, with the region of every object."""
    members, facts = heap(spark, sf_dir)
    held, regions = storegraph.solve(*(written(x) for x in facts))
    return _for_all(held.join(regions, "obj").select("slot", "obj", "region"), members, "slot", "obj", "region")
