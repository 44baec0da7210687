"""Queries of the graph kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..shared import written
from .base import EDGE, FLOW, TREE, edges, flow, nodes, query, roots, table, tree

_REACH = f"WITH RECURSIVE {EDGE}, walk(src, dst) AS (SELECT src, dst FROM edge UNION SELECT w.src, e.dst FROM walk w JOIN edge e ON w.dst = e.src)"


def _root(spark, sf_dir, e):
    return e.agg(F.min("src").alias("node"))


@query("gra01", f"{_REACH} SELECT id AS node FROM node WHERE top UNION SELECT dst FROM walk WHERE src IN (SELECT id FROM node WHERE top)")
def reach(spark, sf_dir):
    return graph.reach(edges(spark, sf_dir), roots(spark, sf_dir))


@query("gra02", f"WITH RECURSIVE {TREE}, lv AS (SELECT node, 0 AS level FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, lv.level + 1 FROM tree t JOIN lv ON t.parent = lv.node) SELECT node, level FROM lv WHERE node IN (SELECT node FROM tree WHERE parent IS NOT NULL UNION SELECT parent FROM tree)")
def topological(spark, sf_dir):
    return graph.topological_levels(tree(spark, sf_dir).filter("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst")))


@query("gra03", f"{_REACH} SELECT src, dst FROM walk WHERE src <> dst")
def closure(spark, sf_dir):
    return graph.closure(edges(spark, sf_dir))


@query("gra04", f"{_REACH} SELECT n.node, least(n.node, min(CASE WHEN b.src IS NOT NULL THEN a.dst END)) AS component FROM (SELECT src AS node FROM edge UNION SELECT dst FROM edge) n LEFT JOIN walk a ON a.src = n.node LEFT JOIN walk b ON b.src = a.dst AND b.dst = n.node GROUP BY n.node")
def strong(spark, sf_dir):
    return graph.strong_components(edges(spark, sf_dir))


_DOM = f"""WITH RECURSIVE {EDGE}, root AS (SELECT id AS r FROM node WHERE top), live(node) AS (SELECT r FROM root UNION SELECT e.dst FROM live l JOIN edge e ON l.node = e.src),
 avoid(node, dom) AS (SELECT r, l.node FROM root JOIN live l ON l.node // 10 = r // 10 WHERE l.node <> r UNION SELECT e.dst, a.dom FROM avoid a JOIN edge e ON a.node = e.src WHERE e.dst <> a.dom),
 dom AS (SELECT a.node, b.node AS dom FROM live a JOIN live b ON a.node // 10 = b.node // 10 LEFT JOIN avoid v ON v.node = a.node AND v.dom = b.node WHERE v.node IS NULL),
 idom AS (SELECT d.node, arg_max(d.dom, c.n) AS idom FROM dom d JOIN (SELECT node, count(*) AS n FROM dom GROUP BY node) c ON d.dom = c.node WHERE d.node <> d.dom GROUP BY d.node)"""


def _doms(spark, sf_dir):
    """The edges of all orders' graphs and their dominators (node, dom), from each order's first line."""
    e = written(edges(spark, sf_dir))
    return e, _from(e, roots(spark, sf_dir))


def _from(e, begin):
    of = F.expr("src div 10").alias("graph")
    return written(graph.dominator_paths(e.select(of, "src", "dst"), begin.select(F.expr("node div 10").alias("graph"), "node")).select("node", F.explode("path").alias("dom")))


@query("gra05", f"{_DOM} SELECT node, idom FROM idom")
def dominator_tree(spark, sf_dir):
    return graph.immediate(_doms(spark, sf_dir)[1])


@query("gra06", f"{_DOM} SELECT node, dom FROM dom")
def dominator_sets(spark, sf_dir):
    return _doms(spark, sf_dir)[1]


@query("gra07", f"{_DOM} SELECT idom AS src, node AS dst, 'D' AS kind FROM idom UNION ALL SELECT e.src, e.dst, 'J' FROM edge e JOIN live l ON e.src = l.node WHERE NOT EXISTS (SELECT 1 FROM idom i WHERE i.node = e.dst AND i.idom = e.src)")
def dj_graph(spark, sf_dir):
    e, doms = _doms(spark, sf_dir)
    d = graph.immediate(doms).select(F.col("idom").alias("src"), F.col("node").alias("dst"))
    live = doms.select(F.col("node").alias("src")).distinct()
    return d.withColumn("kind", F.lit("D")).union(e.join(live, "src").select("src", "dst").join(d, ["src", "dst"], "left_anti").withColumn("kind", F.lit("J")))


_DF = f"{_DOM}, df AS (SELECT DISTINCT d.dom AS node, e.dst AS frontier FROM edge e JOIN dom d ON d.node = e.src WHERE NOT EXISTS (SELECT 1 FROM dom s WHERE s.node = e.dst AND s.dom = d.dom AND s.node <> s.dom))"


@query("gra08", f"{_DF}, idf(node, frontier) AS (SELECT node, frontier FROM df UNION SELECT i.node, f.frontier FROM idf i JOIN df f ON i.frontier = f.node) SELECT node, frontier FROM idf")
def iterated_frontier(spark, sf_dir):
    e, doms = _doms(spark, sf_dir)
    df = graph.frontier(e, doms)
    return graph.closure(df.select(F.col("node").alias("src"), F.col("frontier").alias("dst")), cycles=True).select(F.col("src").alias("node"), F.col("dst").alias("frontier"))


@query("gra09", f"{_DF} SELECT node, frontier FROM df")
def dominance_frontier(spark, sf_dir):
    return graph.frontier(*_doms(spark, sf_dir))


@query("gra10", _DOM.replace("edge AS (SELECT DISTINCT src, dst", "edge AS (SELECT DISTINCT dst AS src, src AS dst").replace("FROM node WHERE top), live", "FROM node WHERE bottom), live") + " SELECT node, dom FROM dom")
def post_dominators(spark, sf_dir):
    """Dominators of the reversed graphs, from each order's last line."""
    return _from(written(graph.reverse(edges(spark, sf_dir))), nodes(spark, sf_dir).filter("bottom").select(F.col("id").alias("node")))


@query("gra11", f"WITH {TREE} SELECT DISTINCT t.node FROM tree t WHERE t.parent IS NULL AND EXISTS (SELECT 1 FROM tree c WHERE c.parent = t.node)")
def entries(spark, sf_dir):
    return graph.entry_points(tree(spark, sf_dir).filter("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst")))


_LEVELS = f"WITH RECURSIVE {EDGE}, lv(node, level) AS (SELECT id, 0 FROM node WHERE top UNION SELECT e.dst, l.level + 1 FROM lv l JOIN edge e ON l.node = e.src WHERE l.level < 25) SELECT node, min(level) AS level FROM lv GROUP BY node"


@query("gra12", _LEVELS)
def bfs(spark, sf_dir):
    return graph.levels(edges(spark, sf_dir), roots(spark, sf_dir))


@query("srt09", f"SELECT node, level FROM ({_LEVELS}) WHERE level <= 2")
def depth_limit(spark, sf_dir):
    return graph.levels(edges(spark, sf_dir), roots(spark, sf_dir), 2)


@query("gra13", "SELECT user_id AS node, min(user_id) OVER (PARTITION BY c) AS component FROM (SELECT DISTINCT user_id, 0 AS c FROM events) WHERE (SELECT count(DISTINCT event_type) FROM events) > 0")
def connected(spark, sf_dir):
    """Users that share an event type, through the bipartite graph of users and types."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src"), F.concat(F.lit("~"), "event_type").alias("dst")).distinct()
    found = graph.components(e).filter("node not like '~%'").withColumn("node", F.col("node").cast("long"))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


@query("gra14")
def spanning(spark, sf_dir):
    """The minimum spanning forest of the orders' graphs, by quantity."""
    return graph.spanning_tree(flow(spark, sf_dir).select("src", "dst", "weight"))


@query("gra16", f"WITH {TREE} SELECT min(parent) OVER () AS component, true AS bipartite FROM tree WHERE false UNION ALL SELECT node, true FROM (SELECT 'R' || r_regionkey AS node FROM region) r WHERE EXISTS (SELECT 1 FROM tree t WHERE t.parent = r.node)")
def bipartite(spark, sf_dir):
    """Whether each region's tree has no odd cycle; components are named by their regions."""
    e = tree(spark, sf_dir).filter("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    comp = graph.components(e).filter("node like 'R%'").select("component", F.col("node").alias("region"))
    return graph.two_colouring(e).join(comp, "component").select(F.col("region").alias("component"), "bipartite")


_UP = f"WITH RECURSIVE {TREE}, up(node, ancestor, distance) AS (SELECT node, node, 0 FROM tree UNION ALL SELECT u.node, t.parent, u.distance + 1 FROM up u JOIN tree t ON u.ancestor = t.node WHERE t.parent IS NOT NULL)"


@query("gra20", f"{_UP}, pairs AS (SELECT DISTINCT 'C' || o_custkey AS a, 'N' || s_nationkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderpriority = '1-URGENT') SELECT p.a, p.b, arg_min(x.ancestor, x.distance) AS lca FROM pairs p JOIN up x ON x.node = p.a JOIN up y ON y.node = p.b AND y.ancestor = x.ancestor GROUP BY p.a, p.b")
def lca(spark, sf_dir):
    """The least common ancestor of customers and the nations that supplied their urgent orders."""
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    pairs = o.join(t("lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = pairs.select(F.concat(F.lit("C"), "o_custkey").alias("a"), F.concat(F.lit("N"), "s_nationkey").alias("b")).distinct()
    return graph.common_ancestor(tree(spark, sf_dir), pairs)


@query("gra23", f"WITH {EDGE} SELECT coalesce(o.node, i.node) AS node, coalesce(outdegree, 0) AS outdegree, coalesce(indegree, 0) AS indegree FROM (SELECT src AS node, count(*) AS outdegree FROM edge GROUP BY src) o FULL JOIN (SELECT dst AS node, count(*) AS indegree FROM edge GROUP BY dst) i ON o.node = i.node")
def degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query("gra28", f"{_UP} SELECT ancestor AS holder, node AS object, distance FROM up WHERE distance > 0")
def heap_search(spark, sf_dir):
    """What each object reaches through its fields, with the number of steps: regions hold nations, nations customers."""
    return graph.ancestors(tree(spark, sf_dir)).filter("distance > 0").select(F.col("ancestor").alias("holder"), F.col("node").alias("object"), "distance")


@query("win03", f"{_UP}, p AS (SELECT node, max(CASE WHEN distance = d THEN ancestor END) AS root, string_agg(ancestor, '/' ORDER BY distance DESC) AS path FROM up JOIN (SELECT node AS n, max(distance) AS d FROM up GROUP BY node) ON n = node GROUP BY node), s AS (SELECT ancestor AS node, count(*) AS size FROM up GROUP BY ancestor) SELECT p.root, p.node, row_number() OVER (PARTITION BY p.root ORDER BY string_split(p.path, '/')) AS pre, row_number() OVER (PARTITION BY p.root ORDER BY string_split(p.path, '/')) + s.size - 1 AS post FROM p JOIN s ON p.node = s.node")
def numbering(spark, sf_dir):
    return graph.intervals(tree(spark, sf_dir))


@query("joi10", f"{_UP} SELECT ancestor AS a, node AS b FROM up")
def dominates(spark, sf_dir):
    """Pairs where a's interval holds b's: candidates are on b's path to the root, so no pairs of one tree are made."""
    t = tree(spark, sf_dir)
    at = graph.intervals(t)
    low = at.select(F.col("node").alias("b"), F.col("pre").alias("b_pre"), F.col("post").alias("b_post"))
    up = graph.ancestors(t).select(F.col("node").alias("b"), F.col("ancestor").alias("node"))
    return up.join(low, "b").join(at, "node").filter("pre <= b_pre and post >= b_post").select(F.col("node").alias("a"), "b")


@query("set04", f"WITH {FLOW} SELECT src, dst FROM flow WHERE kind = '1-URGENT' UNION SELECT src, dst FROM flow WHERE kind = '2-HIGH'")
def merge_graphs(spark, sf_dir):
    f = flow(spark, sf_dir)
    return f.filter("kind = '1-URGENT'").select("src", "dst").unionByName(f.filter("kind = '2-HIGH'").select("src", "dst")).distinct()


@query("set05", f"WITH {FLOW} SELECT DISTINCT src, dst FROM flow")
def union_graphs(spark, sf_dir):
    return flow(spark, sf_dir).select("src", "dst").distinct()


@query("cgr03", f"WITH {FLOW} SELECT src AS caller, string_agg(DISTINCT CAST(dst AS VARCHAR), ', ' ORDER BY CAST(dst AS VARCHAR)) AS callees FROM flow GROUP BY src")
def call_graph_container(spark, sf_dir):
    return flow(spark, sf_dir).groupBy(F.col("src").alias("caller")).agg(F.array_join(F.array_sort(F.collect_set(F.col("dst").cast("string"))), ", ").alias("callees"))


@query("cgr04", f"{_REACH}, root AS (SELECT id AS r FROM node WHERE top) SELECT 'none' AS caller, CAST(r AS VARCHAR) AS callee FROM root UNION SELECT CAST(e.src AS VARCHAR), CAST(e.dst AS VARCHAR) FROM edge e WHERE e.src IN (SELECT r FROM root UNION SELECT dst FROM walk, root WHERE src = r)")
def live_code(spark, sf_dir):
    """Edges from live callers, with a virtual head before the entry point."""
    e = edges(spark, sf_dir)
    root = written(roots(spark, sf_dir))
    live = graph.reach(e, root)
    text = lambda c: F.col(c).cast("string")
    return root.select(F.lit("none").alias("caller"), text("node").alias("callee")).union(e.join(live, e["src"] == live["node"]).select(text("src"), text("dst"))).distinct()


#: Each part and the part on the next line of its order: a graph of whole tables that grows with them.
PARTS = "part_edge AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def part_edges(spark, sf_dir):
    """(src, dst): one equality join, as the next line's key is known."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return written(lines.join(following, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").distinct())


@query("gra01_parts", f"WITH RECURSIVE {PARTS}, walk(node) AS (SELECT min(src) FROM part_edge UNION SELECT e.dst FROM walk w JOIN part_edge e ON w.node = e.src) SELECT node FROM walk")
def reach_parts(spark, sf_dir):
    e = part_edges(spark, sf_dir)
    return graph.reach(e, _root(spark, sf_dir, e))


@query("gra12_parts", f"WITH RECURSIVE {PARTS}, lv(node, level) AS (SELECT min(src), 0 FROM part_edge UNION SELECT e.dst, l.level + 1 FROM lv l JOIN part_edge e ON l.node = e.src WHERE l.level < 20) SELECT node, min(level) AS level FROM lv GROUP BY node")
def levels_parts(spark, sf_dir):
    e = part_edges(spark, sf_dir)
    return graph.levels(e, _root(spark, sf_dir, e))


@query("gra11_parts", f"WITH {PARTS} SELECT src AS node FROM part_edge EXCEPT SELECT dst FROM part_edge")
def entries_parts(spark, sf_dir):
    return graph.entry_points(part_edges(spark, sf_dir))


@query("gra23_parts", f"WITH {PARTS}, o AS (SELECT src AS node, count(*) AS outdegree FROM part_edge GROUP BY src), i AS (SELECT dst AS node, count(*) AS indegree FROM part_edge GROUP BY dst) SELECT coalesce(o.node, i.node) AS node, coalesce(outdegree, 0) AS outdegree, coalesce(indegree, 0) AS indegree FROM o FULL JOIN i ON o.node = i.node")
def degrees_parts(spark, sf_dir):
    return graph.degrees(part_edges(spark, sf_dir))


@query("gra13_parts", f"WITH RECURSIVE {PARTS}, two(a, b) AS (SELECT src, dst FROM part_edge UNION SELECT dst, src FROM part_edge), walk(node) AS (SELECT min(a) FROM two UNION SELECT b FROM walk JOIN two ON node = a) SELECT count(*) AS nodes, min(node) AS component FROM walk")
def component_of_parts(spark, sf_dir):
    """The component of the least part: how many parts are in it."""
    found = graph.components(part_edges(spark, sf_dir))
    return found.groupBy("component").agg(F.count("*").alias("nodes")).orderBy("component").limit(1).select("nodes", "component")


@query("gra04_parts", f"WITH RECURSIVE {PARTS}, ahead(node) AS (SELECT min(src) FROM part_edge UNION SELECT e.dst FROM ahead w JOIN part_edge e ON w.node = e.src), back(node) AS (SELECT min(src) FROM part_edge UNION SELECT e.src FROM back w JOIN part_edge e ON w.node = e.dst) SELECT node FROM ahead INTERSECT SELECT node FROM back")
def strong_component_of_parts(spark, sf_dir):
    """The strong component of the least part with a following one."""
    e = part_edges(spark, sf_dir)
    found = written(graph.strong_components(e))
    own = found.join(_root(spark, sf_dir, e), "node").select("component")
    return found.join(own, "component").select("node")
