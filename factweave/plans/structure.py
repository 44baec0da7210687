"""Predicates, exclusion, load elimination, cloning and switches over the programs that orders describe: a line leads to the
next one (N), to the next two (R) or past the next one (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cloning, dataflow, graph, pointsto
from ..shared import written
from .base import query, table

_LINES = """l AS (SELECT l_orderkey AS p, l_linenumber AS j, max(l_returnflag) AS flag, max(l_linestatus) AS status, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
line AS (SELECT *, lead(j) OVER w AS next, lead(j, 2) OVER w AS after, min(j) OVER (PARTITION BY p) AS first FROM l WINDOW w AS (PARTITION BY p ORDER BY j)),
e AS (SELECT p, j, next AS k FROM line WHERE next IS NOT NULL AND (flag <> 'A' OR after IS NULL) UNION ALL SELECT p, j, after FROM line WHERE after IS NOT NULL AND flag <> 'N')"""

_OVER = f"""{_LINES}, r(p, n) AS (SELECT DISTINCT p, first FROM line UNION SELECT e.p, e.k FROM r JOIN e ON e.p = r.p AND e.j = r.n),
a(p, x, n) AS (SELECT p, j, first FROM line WHERE j <> first UNION SELECT a.p, a.x, e.k FROM a JOIN e ON e.p = a.p AND e.j = a.n WHERE e.k <> a.x),
d AS (SELECT r.p, r.n, x.j AS x FROM r JOIN line x ON x.p = r.p LEFT JOIN a ON a.p = r.p AND a.n = r.n AND a.x = x.j WHERE a.p IS NULL AND (x.j = r.n OR x.j = x.first OR x.j IN (SELECT n FROM r r2 WHERE r2.p = r.p)))"""


def lines(spark, sf_dir):
    """(p, j, flag, status, q, next, after, first) of each order's lines."""
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("p"), F.col("l_linenumber").alias("j")).agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.max("l_quantity").alias("q"))
    w = Window.partitionBy("p").orderBy("j")
    return written(one.select("*", F.lead("j").over(w).alias("next"), F.lead("j", 2).over(w).alias("after"), F.min("j").over(Window.partitionBy("p")).alias("first")))


def edges(l):
    """(graph, src, dst) of all orders."""
    near = l.filter("next is not null and (flag <> 'A' or after is null)").select(F.col("p").alias("graph"), F.col("j").alias("src"), F.col("next").alias("dst"))
    return near.unionByName(l.filter("after is not null and flag <> 'N'").select(F.col("p").alias("graph"), F.col("j").alias("src"), F.col("after").alias("dst")))


def _over(l):
    return dataflow.predicates(edges(l), l.select(F.col("p").alias("graph"), F.col("first").alias("node")).distinct())


@query("dfi03", f"WITH RECURSIVE {_OVER} SELECT p, n AS pred, string_agg(CAST(x AS VARCHAR), '.' ORDER BY x) AS over FROM d GROUP BY p, n")
def predicates(spark, sf_dir):
    """The predicates that hold whenever a line's does."""
    return _over(lines(spark, sf_dir)).select(F.col("graph").alias("p"), "pred", F.array_join(F.transform("over", lambda x: x.cast("string")), ".").alias("over"))


@query("dfi05", f"""WITH RECURSIVE {_OVER},
f AS (SELECT *, count(*) FILTER (WHERE status = 'F') OVER (PARTITION BY p, flag ORDER BY j) AS heap, max(CASE WHEN status = 'O' THEN j END) OVER (PARTITION BY p ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS load FROM line),
m AS (SELECT o.p, 'l' || o.j AS dst, CASE WHEN s.q > 25 AND s.load IS NOT NULL THEN 'l' || s.load ELSE 'v' || s.j END AS src FROM f o JOIN f s ON s.p = o.p AND s.flag = o.flag AND s.heap = o.heap AND s.status = 'F' AND o.status = 'O' JOIN d ON d.p = o.p AND d.n = o.j AND d.x = s.j),
w(p, dst, src) AS (SELECT * FROM m UNION SELECT w.p, w.dst, m.src FROM w JOIN m ON m.p = w.p AND m.dst = w.src)
SELECT w.p, w.dst, w.src FROM w LEFT JOIN m ON m.p = w.p AND m.dst = w.src WHERE m.p IS NULL""")
def answered_loads(spark, sf_dir):
    """F lines store in their flag's field, O lines load from it; large stores store what the load before gave."""
    l = lines(spark, sf_dir)
    w = Window.partitionBy("p", "flag").orderBy("j")
    f = l.withColumn("heap", F.count(F.when(F.col("status") == "F", 1)).over(w)).withColumn("load", F.max(F.when(F.col("status") == "O", F.col("j"))).over(Window.partitionBy("p").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)))
    of = lambda kind, c: f.filter(F.col("status") == kind).select(F.col("p").alias("graph"), c, F.col("j").alias("pred"), F.lit("x").alias("obj"), F.col("flag").alias("field"), "heap")
    src = F.when((F.col("q") > 25) & F.col("load").isNotNull(), F.concat(F.lit("l"), "load")).otherwise(F.concat(F.lit("v"), "j")).alias("src")
    return dataflow.answered(of("O", F.concat(F.lit("l"), "j").alias("dst")), of("F", src), written(_over(l))).select(F.col("graph").alias("p"), "dst", "src")


@query("gra22", f"""WITH RECURSIVE {_LINES}, c(p, a, b) AS (SELECT p, j, k FROM e UNION SELECT c.p, c.a, e.k FROM c JOIN e ON e.p = c.p AND e.j = c.b)
SELECT x.p, count(c.p) = 0 AS exclusive FROM line x LEFT JOIN (SELECT c.* FROM c JOIN line y ON y.p = c.p AND y.j = c.b AND y.status = 'F') c ON c.p = x.p AND c.a = x.j WHERE x.status = 'F' GROUP BY x.p""")
def exclusive(spark, sf_dir):
    """Whether an order's finished lines lie on mutually exclusive branches."""
    l = lines(spark, sf_dir)
    sets = l.filter("status = 'F'").select(F.col("p").alias("graph"), F.col("status").alias("set"), F.col("j").alias("node"))
    return graph.exclusive(edges(l), sets).select(F.col("graph").alias("p"), "exclusive")


@query("opt08", f"""WITH {_LINES}, s AS (SELECT p * 10 + j AS ctx, flag AS code, string_agg(flag || status, '') OVER (PARTITION BY p ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM line)
SELECT ctx, code, min(ctx) OVER (PARTITION BY tail) AS "group" FROM s""")
def clones(spark, sf_dir):
    """Contexts of three functions (flags), each calling the next line's: those with equal calls from there on share code."""
    l = lines(spark, sf_dir)
    ctx = lambda j: F.col("p") * 10 + F.col(j)
    contexts = l.select(ctx("j").alias("ctx"), F.col("flag").alias("code"), F.col("status").alias("facts"))
    return cloning.shared_code(contexts, l.filter("next is not null").select(ctx("j").alias("ctx"), F.lit(0).alias("op"), ctx("next").alias("callee")))


@query("pts07", f"""WITH RECURSIVE {_LINES}, h(p, j, o) AS (SELECT DISTINCT p, first, first FROM line
  UNION SELECT h.p, x.next, CASE x.flag WHEN 'R' THEN x.j ELSE h.o END FROM h JOIN line x ON x.p = h.p AND x.j = h.j JOIN line y ON y.p = h.p AND y.j = h.o WHERE x.next IS NOT NULL AND (x.flag = 'N' OR y.status = 'F'))
SELECT p || '.' || j AS slot, p || '.' || o AS obj FROM h""")
def switches(spark, sf_dir):
    """What lines' slots hold: N passes on all, A only objects of kind F, and R its own object if a true one (F) arrives."""
    l = lines(spark, sf_dir)
    at = lambda *c: F.concat_ws(".", "p", *c)
    inner = l.filter("next is not null")
    own = l.select(at(F.lit("o"), "j").alias("slot"), at("j").alias("obj"))
    alloc = own.union(l.filter("j = first").select(at("j"), at("j")))
    kinds = l.select(at("j").alias("obj"), F.col("status").alias("kind"))
    branches = inner.filter("flag = 'R'").select(at("j").alias("cond"), F.lit(True).alias("truth"), at(F.lit("o"), "j").alias("src"), at("next").alias("dst"))
    types = inner.filter("flag = 'A'").select(at("j").alias("cond"), F.lit("F").alias("kind"), at("next").alias("dst"))
    copies = inner.filter("flag = 'N'").select(at("j").alias("src"), at("next").alias("dst"))
    held = pointsto.switched(alloc, copies, kinds.select("obj", (F.col("kind") == "F").alias("truth")), branches, types, kinds)
    return held.join(own.select("slot"), "slot", "left_anti")
