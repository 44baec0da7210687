"""Graph kernels over edge tables (src, dst), as joins to a fixpoint. Node ids may be of any type that has an order."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import replaced, written
from .fixpoint import fixpoint


def nodes(edges: DataFrame) -> DataFrame:
    """All ends of edges as (node)."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def entry_points(edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes(edges).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reachable from roots (node), roots included."""
    e = edges.select("src", "dst").distinct()
    return fixpoint(roots.select("node"), lambda d, _: d.join(e, d["node"] == e["src"]).select(F.col("dst").alias("node")))[0]


def levels(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, level): the breadth-first distance from the roots, up to ``depth``."""
    e = edges.select("src", "dst").distinct()
    seed = roots.select("node", F.lit(0).alias("level"))
    return fixpoint(seed, lambda d, _: d.join(e, d["node"] == e["src"]).select(F.col("dst").alias("node"), (F.col("level") + 1).alias("level")), ["node"], depth)[0]


def closure(edges: DataFrame, cycles: bool = False) -> DataFrame:
    """(src, dst) for each path of one edge or more; a node's path to itself only with ``cycles``."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    out = fixpoint(edges.select("src", "dst"), lambda d, _: d.join(e, d["dst"] == e["a"]).select("src", F.col("b").alias("dst")))[0]
    return out if cycles else out.filter("src <> dst")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each strongly connected component.

    Forward and backward label colouring: in each round the least label that reaches a node forward and the least one
    backward are found; nodes where both agree form components and leave the graph.
    """
    done, rest = None, written(edges.select("src", "dst").distinct())
    left = written(nodes(edges))
    while not left.isEmpty():
        low = _least(left, rest)
        root = low.filter("node = label").select(F.col("node").alias("r"))
        inside = written(rest.join(low.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(low.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").select("src", "dst", "a"))
        back = fixpoint(root.select(F.col("r").alias("node"), F.col("r").alias("component")), lambda d, _, i=inside: d.join(i, (d["node"] == i["dst"]) & (d["component"] == i["a"])).select(F.col("src").alias("node"), "component"))[0]
        done = back if done is None else written(done.unionByName(back))
        gone = back.select("node")
        left = written(left.join(gone, "node", "left_anti"))
        rest = written(rest.join(gone, rest["src"] == gone["node"], "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return done if done is not None else nodes(edges).withColumn("component", F.col("node"))


def _least(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node that reaches each node."""
    state = written(start.select("node", F.col("node").alias("label")))
    while True:
        came = state.join(edges, state["node"] == edges["src"]).select(F.col("dst").alias("node"), "label")
        new = written(state.union(came).groupBy("node").agg(F.min("label").alias("label")))
        if new.join(state, ["node", "label"], "left_anti").isEmpty():
            return new
        state = new


def _rooted(parents: DataFrame) -> DataFrame:
    """(node, label): the root of each node, by pointer jumping; parents (node, label) lead to roots, which are their own parents."""
    names, path = replaced(parents, None)
    while True:
        far = names.join(names.select(F.col("node").alias("label"), F.col("label").alias("root")), "label")
        new, path = replaced(far.select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")), path)
        names = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return names


def components(edges: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node of each connected component, directions aside; ``alone`` adds nodes without edges.

    In each round nodes follow their least neighbour, if it is less than they, to a root; then edges are between roots, and those
    that are left are fewer. A component's least node is a root in all rounds. Rounds' names are put together from the last one on.
    """
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    left, path = replaced(ends.filter("src < dst").distinct(), None)
    named = []
    while not left.isEmpty():
        near = left.select(F.col("dst").alias("node"), F.col("src").alias("label")).union(left.select("src", "src"))
        names = _rooted(near.groupBy("node").agg(F.min("label").alias("label")))
        named.append(names)
        moved = left.join(names.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        left, path = replaced(moved.filter("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), path)
    found = None
    for names in reversed(named):
        if found is not None:
            names = names.join(found.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left").select("node", F.coalesce("last", "label").alias("label"))
        found = written(names)
    single = nodes(edges.filter("not coalesce(src <> dst, false)"))
    if alone is not None:
        single = single.union(alone.select("node")).distinct()
    single = single.select("node", F.col("node").alias("component"))
    return single if found is None else found.select("node", F.col("label").alias("component")).union(single.join(found, "node", "left_anti"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from an entry point; raises ValueError if there is a cycle."""
    e = written(edges.select("src", "dst").distinct())
    left = written(nodes(e))
    done, level = None, 0
    while not left.isEmpty():
        held = e.select(F.col("dst").alias("node")).distinct()
        ready = written(left.join(held, "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        done = ready if done is None else done.unionByName(ready)
        left = written(left.join(ready, "node", "left_anti"))
        e = written(e.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def shared_prefix(a: str, b: str) -> Column:
    """The longest common prefix of two array columns."""
    return F.expr(f"slice({a}, 1, coalesce(nullif(array_position(transform(sequence(1, greatest(least(size({a}), size({b})), 1)), i -> {a}[i - 1] <=> {b}[i - 1]), false), 0) - 1, least(size({a}), size({b}))))")


def dominator_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph, node, path): the dominators of the nodes that roots (graph, node) reach over edges (graph, src, dst), from the root to the node.

    A node's path is what the paths of all its predecessors begin with, and itself. The common beginning of many arrays is
    that of the least and the greatest, so predecessors meet in one aggregation with partial sums; paths only get shorter
    once all nodes are reached, and nothing is kept of pairs of nodes.
    """
    e = written(edges.filter("src <> dst").select("graph", "src", "dst").distinct().join(roots.select("graph", F.col("node").alias("dst")), ["graph", "dst"], "left_anti"))
    start = written(roots.select("graph", "node", F.array("node").alias("path")).distinct())
    state = start
    while True:
        came = e.join(state.select("graph", F.col("node").alias("src"), "path"), ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
        new = written(came.select("graph", "node", F.concat(shared_prefix("lo", "hi"), F.array("node")).alias("path")).unionByName(start))
        if new.join(state, ["graph", "node", "path"], "left_anti").isEmpty():
            return new
        state = new


def dominators(edges: DataFrame, root) -> DataFrame:
    """(node, dom): all dominators of the nodes that ``root`` reaches."""
    one = edges.sparkSession.createDataFrame([(root,)], edges.select(F.col("src").alias("node")).schema).select(F.lit(0).alias("graph"), "node")
    return dominator_paths(edges.select(F.lit(0).alias("graph"), "src", "dst"), one).select("node", F.explode("path").alias("dom"))


def exclusive(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(graph, set, exclusive): whether no path of edges (graph, src, dst) leads over two nodes of a set (graph, set, node).

    Only from the asked nodes is followed what they reach; a set is exclusive if none of its nodes reaches another.
    """
    e = edges.select("graph", "src", "dst").distinct()
    asked = sets.select("graph", F.col("node").alias("begin")).distinct()
    seed = e.join(asked, (e["graph"] == asked["graph"]) & (e["src"] == asked["begin"])).select(e["graph"], "begin", F.col("dst").alias("node"))
    seen = fixpoint(seed, lambda d, _: d.join(e.withColumnRenamed("src", "node"), ["graph", "node"]).select("graph", "begin", F.col("dst").alias("node")))[0]
    named = sets.select("graph", "set", "node").distinct()
    met = seen.filter("begin <> node").join(named, ["graph", "node"]).join(named.select("graph", "set", F.col("node").alias("begin")), ["graph", "set", "begin"]).select("graph", "set").distinct()
    return named.select("graph", "set").distinct().join(met.withColumn("met", F.lit(True)), ["graph", "set"], "left").select("graph", "set", F.col("met").isNull().alias("exclusive"))


def immediate(doms: DataFrame) -> DataFrame:
    """(node, idom): of the strict dominators that with the most dominators itself."""
    depth = doms.groupBy("node").agg(F.count("*").alias("depth"))
    strict = doms.filter("node <> dom").join(depth.select(F.col("node").alias("dom"), "depth"), "dom")
    return strict.groupBy("node").agg(F.max_by("dom", "depth").alias("idom"))


def frontier(edges: DataFrame, doms: DataFrame) -> DataFrame:
    """(node, frontier): y where node dominates a predecessor of y but not y strictly."""
    e = edges.select(F.col("src").alias("p"), F.col("dst").alias("frontier")).distinct()
    reached = e.join(doms.select(F.col("node").alias("p"), F.col("dom").alias("node")), "p").select("node", "frontier").distinct()
    strict = doms.filter("node <> dom").select(F.col("node").alias("frontier"), F.col("dom").alias("node"))
    return reached.join(strict, ["node", "frontier"], "left_anti")


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of the minimum spanning forest: Boruvka rounds, ties by the ends.

    Each tree takes its lightest edge and follows it; the lesser of two that take the same edge is the root of all that come to
    them. Edges between the trees that this makes are what the next round reads.
    """
    once = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").filter("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    left, path = replaced(once.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "src", "dst"), None)
    taken = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a", "weight", "src", "dst"))
        best = both.groupBy("a").agg(F.min(F.struct("weight", "src", "dst", "b")).alias("e")).select("a", "e.*")
        chosen = written(best.groupBy("src", "dst", "weight").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.min("b").alias("b")))
        taken.append(chosen.select("src", "dst", "weight"))
        alone = F.struct(F.col("lo").alias("node"), F.col("b").alias("label"))
        pair = [F.struct(F.col(c).alias("node"), F.col("lo").alias("label")) for c in ("lo", "hi")]
        names = _rooted(chosen.select(F.explode(F.when(F.col("lo") == F.col("hi"), F.array(alone)).otherwise(F.array(*pair))).alias("n")).select("n.*"))
        to = lambda c: names.select(F.col("node").alias(c), F.col("label").alias(f"new_{c}"))
        moved = left.join(to("a"), "a").join(to("b"), "b").filter("new_a <> new_b")
        left, path = replaced(moved.select(F.col("new_a").alias("a"), F.col("new_b").alias("b"), "weight", "src", "dst"), path)
    return functools.reduce(DataFrame.union, taken) if taken else left.select("src", "dst", "weight")


def two_colouring(edges: DataFrame) -> DataFrame:
    """(component, bipartite): whether no edge joins nodes at equal parity from the component's least node."""
    comp = written(components(edges))
    roots = comp.filter("node = component").select("node")
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    depth = levels(both, roots).select("node", (F.col("level") % 2).alias("parity"))
    odd = edges.join(depth.select(F.col("node").alias("src"), F.col("parity").alias("a")), "src").join(depth.select(F.col("node").alias("dst"), F.col("parity").alias("b")), "dst").filter("a = b")
    bad = odd.join(comp, odd["src"] == comp["node"]).select("component").distinct().withColumn("odd", F.lit(True))
    return comp.select("component").distinct().join(bad, "component", "left").select("component", F.col("odd").isNull().alias("bipartite"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outdegree, indegree)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outdegree"))
    came = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("indegree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.join(came, "node", "full").select("node", zero("outdegree"), zero("indegree"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of a forest (node, parent), each node its own ancestor at distance 0."""
    p = parents.filter("parent is not null").select(F.col("node").alias("c"), "parent").distinct()
    every = parents.select("node").union(p.select("parent")).distinct()
    seed = every.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    return fixpoint(seed, lambda d, _: d.join(p, d["ancestor"] == p["c"]).select("node", F.col("parent").alias("ancestor"), (F.col("distance") + 1).alias("distance")), ["node", "ancestor"])[0]


def common_ancestor(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lca) for pairs (a, b) of a forest's nodes."""
    up = written(ancestors(parents))
    x = up.select(F.col("node").alias("a"), "ancestor", F.col("distance").alias("d"))
    y = up.select(F.col("node").alias("b"), "ancestor")
    return pairs.join(x, "a").join(y, ["b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", "d").alias("lca"))


def intervals(parents: DataFrame) -> DataFrame:
    """(node, pre, post) of a forest: pre-order numbers with children in order, and the last number below each node."""
    up = ancestors(parents)
    path = up.groupBy("node").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))), lambda s: s["ancestor"])).alias("path"))
    size = up.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size"))
    root = path.withColumn("root", F.col("path")[0])
    inside = root.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("path")))
    return inside.join(size, "node").select("root", "node", F.col("k").cast("long").alias("pre"), (F.col("k") + F.col("size") - 1).cast("long").alias("post"))
