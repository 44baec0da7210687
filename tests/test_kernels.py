"""Kernels against brute force on small graphs, and the edge cases of tables."""

import itertools
import os
import random

import pytest

from factweave.operators import flow, graph, order, rules
from factweave.plans.passes import Engine, standard
from factweave.sources import python


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


@pytest.fixture(scope="module")
def random_graph():
    rng = random.Random(5)
    return sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(18)} | {(3, 3)})


def closure_of(pairs):
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= more
    return out


def test_closure_and_components(spark, random_graph):
    e = edges_of(spark, random_graph)
    whole = closure_of(random_graph)
    assert {tuple(r) for r in graph.closure(e, cycles=True).collect()} == whole
    nodes = {x for p in random_graph for x in p}
    strong = {n: min([n, *(m for m in nodes if (n, m) in whole and (m, n) in whole)]) for n in nodes}
    assert {r.node: r.component for r in graph.strong_components(e).collect()} == strong
    both = closure_of(set(random_graph) | {(b, a) for a, b in random_graph})
    weak = {n: min([n, *(m for m in nodes if (n, m) in both)]) for n in nodes}
    assert {r.node: r.component for r in graph.components(e).collect()} == weak


def test_dominators_agree_with_paths(spark):
    pairs = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (4, 5), (6, 5)]
    doms = {(r.node, r.dom) for r in graph.dominators(edges_of(spark, pairs), 0).collect()}
    out = {k: [b for a, b in pairs if a == k] for k in range(7)}
    assert doms == {(n, d) for n, s in flow.dominator_sets(out, 0).items() for d in s}
    with pytest.raises(ValueError):
        graph.topological_levels(edges_of(spark, pairs))


def test_empty_graph(spark):
    e = edges_of(spark, [])
    assert graph.closure(e).count() == graph.components(e).count() == graph.strong_components(e).count() == 0


def test_memory_dependences(spark):
    ops = [(1, "write"), (2, "read"), (3, "write"), (4, "read"), (5, "write")]
    frame = spark.createDataFrame([(i, i, "x", m) for i, m in ops], "op long, ts long, slot string, mode string")
    got = {tuple(r) for r in order.memory_dependences(frame, compat=False).collect()}
    assert got == {(1, 2, "RAW"), (1, 3, "WAW"), (3, 4, "RAW"), (3, 5, "WAW"), (2, 3, "WAR"), (4, 5, "WAR")}


SOURCE = '''import pickle as pk
import hashlib
password = "hunter2"
def load(path, token="abc"):
    if path:
        return pk.loads(path)
    while True:
        x = hashlib.md5(path)
        break
    total = 0
    for k in range(3):
        total = total + k
    exec(x)  # nosec B102
    return total
def outer():
    def inner():
        load(1)
    inner()
outer()
'''


def test_rules_and_call_graph(spark):
    files = spark.createDataFrame([(1, SOURCE), (2, "def broken(:"), (3, ""), (4, None)], "file_id long, text string")
    found = standard(Engine({"files": files})).run(["issues", "call_graph"])
    assert {(r.test_id, r.lineno) for r in found["issues"].collect()} == {("B403", 1), ("B105", 3), ("B107", 4), ("B301", 6), ("B304", 8)}
    assert {(r.caller, r.callee) for r in found["call_graph"].collect()} == {("main", "main.outer"), ("main.outer", "main.outer.inner"), ("main.outer.inner", "main.load"), ("main.outer", "main.load")}
    assert {r.line for r in python.suppressions(files).collect()} == {13}
    assert rules.filtered(found["issues"], "MEDIUM").count() == 2


def test_flow_graph():
    f = flow.flows(SOURCE)["main.load"]
    graph_ = f.successors()
    doms = flow.dominator_sets(graph_, 0)
    assert 1 in doms and all(0 in d for d in doms.values())
    assert {v for _, v in flow.phis(f)} == {"total", "k"} - {"k"}
    heads = {h for h, _ in flow.natural_loops(f)}
    assert len(heads) == 1 and all(f.kind[h] == "loop" for h in heads)
    control = flow.control_dependences(f)
    assert all(f.kind[a] in ("switch", "loop", "entry") for a, _, _ in control) and control


def test_engine_order():
    e = Engine()
    e.register("a", lambda c: None)
    e.register("b", lambda c: None, ["a"])
    e.register("c", lambda c: None, ["b"])
    assert e.order(["c"]) == ["a", "b", "c"]
    e.run()
    assert e.changed("a") == {"a", "b", "c"}
    e.register("d", lambda c: None, ["e"])
    e.register("e", lambda c: None, ["d"])
    with pytest.raises(ValueError):
        e.order()


def test_combinatorics():
    from factweave.operators import combinatorics as c

    rng = random.Random(6)
    for _ in range(50):
        v = [rng.randrange(10) for _ in range(8)]
        best = max(len(s) for n in range(9) for s in itertools.combinations(v, n) if all(a < b for a, b in itertools.pairwise(s)))
        assert len(c.increasing(v)) == best
        g = {a: set() for a in range(5)}
        for a in g:
            for b in range(5):
                if rng.random() < 0.4:
                    g[a].add(100 + b)
        owner = c.matching(g)
        assert all(r in g[l] for r, l in owner.items()) and len(set(owner.values())) == len(owner)
        most = max(len(s) for n in range(6) for s in itertools.combinations([(a, b) for a in g for b in g[a]], n) if len({x for x, _ in s}) == len(s) == len({y for _, y in s}))
        assert len(owner) == most
    assert c.cut_nodes({1: {2}, 2: {1, 3}, 3: {2}}) == {2}


def test_stream(spark, tmp_path):
    from factweave.streaming import runs

    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        runs.follow(spark, str(tmp_path / "in"), "id long", str(tmp_path / "mark"), lambda frame, _: seen.append(frame.count())).awaitTermination(60)
    assert sum(seen) == 5


def test_long_chain_keeps_few_parts(spark, monkeypatch):
    """A chain of 90 rounds: rows are written again at most twice, and the result is whole."""
    from factweave.operators import fixpoint as module

    again, real = [], module.written
    monkeypatch.setattr(module, "written", lambda df: again.append(df) or real(df))
    n = 90
    e = edges_of(spark, [(k, k + 1) for k in range(n)])
    rows, rounds, converged = module.fixpoint(spark.createDataFrame([(0,)], "node long"), lambda d, _: d.join(e, d["node"] == e["src"]).select(e["dst"].alias("node")))
    assert converged and rounds == n + 1 and sorted(r.node for r in rows.collect()) == list(range(n + 1))
    assert len(again) <= n + 2 + n // 9 + n // 81 + 1 and len(rows.inputFiles()) < 40


def test_call_graph_leaves_out_attributes(spark):
    from factweave.operators import callgraph

    text = "class A:\n    def go(self):\n        pass\ndef run(a):\n    a.go()\n    def inner():\n        help()\ndef help():\n    pass\nrun(A())\n"
    nodes = python.parse(spark.createDataFrame([(1, text)], "file_id long, text string"))
    assert {tuple(r) for r in callgraph.call_graph(nodes).collect()} == {(1, "main", "main.run"), (1, "main.run", "main.help"), (1, "main.run.inner", "main.help")}


def test_files_of_one_split_are_parsed_by_many_tasks(spark):
    """What is parsed comes from one split of a small file; its work is dealt to several tasks, and nothing is lost."""
    from pyspark.sql import functions as F

    one = spark.range(1200, numPartitions=1).select(F.col("id").alias("file_id"), F.lit("def f(a):\n    return a  # nosec\n").alias("text"))
    for found in (python.parse(one).filter("kind = 'FunctionDef'"), python.suppressions(one), flow.blocks(one).filter("kind = 'exit'")):
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 1200


def test_comments_of_files_without_any(spark):
    texts = [(1, None), (2, "x = 1\n"), (3, "x = '#'\n"), (4, "x = 1  # nosec B101\n# all\n")]
    got = python.suppressions(spark.createDataFrame(texts, "file_id long, text string")).collect()
    assert {(r.file_id, r.line, tuple(r.ids) if r.ids is not None else None) for r in got} == {(4, 1, ("B101",)), (4, 2, None)}


def test_range_minimum_of_ranges_in_any_order(spark):
    """Ranges may come in another order each time they are read, as after a shuffle; both ends of a range still belong together."""
    import numpy as np

    rng = random.Random(3)
    rows = [(k, at, float(rng.randrange(1000))) for k in range(40) for at in range(9)]
    asked = [(k, lo, lo + 1 + (k + lo) % 5) for k in range(40) for lo in range(5)]
    shuffled = spark.createDataFrame(asked, "g long, lo long, hi long").coalesce(1).mapInPandas(lambda it: (f.iloc[np.random.default_rng().permutation(len(f))] for f in it), "g long, lo long, hi long")
    got = order.range_minimum(spark.createDataFrame(rows, "g long, at long, v double"), "g", "at", "v", shuffled)
    want = {(k, lo, hi, min(v for key, at, v in rows if key == k and lo <= at < hi)) for k, lo, hi in asked}
    assert sorted(tuple(r) for r in got.select("g", "lo", "hi", "least").collect()) == sorted(want)


def test_per_graph_takes_many_graphs_at_once(spark):
    """Each key's graph gives its own rows, and a batch holds many keys, also ones whose edges give none."""
    from factweave.operators import combinatorics

    rng = random.Random(8)
    edges = [(f"g{k}", rng.randrange(6), rng.randrange(6)) for k in range(300) for _ in range(rng.randrange(1, 9))]
    frame = spark.createDataFrame(edges, "kind string, src long, dst long")
    sizes = []

    def cuts(graph):
        sizes.append(len(graph))  # per process: many graphs meet in one call of the batch function
        return [(n, len(sizes)) for n in sorted(combinatorics.cut_nodes(graph))]

    got = combinatorics.per_graph(frame.coalesce(1), "kind", cuts, "kind string, node long, seen long").collect()
    want = {(k, n) for k in {e[0] for e in edges} for n in combinatorics.cut_nodes(combinatorics.neighbours([(a, b) for kind, a, b in edges if kind == k]))}
    assert {(r.kind, r.node) for r in got} == want and len(got) == len(want) and max(r.seen for r in got) > 10


def test_equal_graphs_are_worked_out_once(spark):
    """A task remembers the graphs that it has seen."""
    from factweave.operators import combinatorics

    edges = spark.createDataFrame([(k, n, n + 1) for k in range(40) for n in range(1 + k % 2)], "kind long, src long, dst long")
    calls = []

    def nodes(graph):
        calls.append(graph)
        return [(n, len(calls)) for n in sorted(graph)]

    got = combinatorics.per_graph(edges.repartition(1, "kind"), "kind", nodes, "kind string, node long, calls long")
    rows = got.collect()
    assert sorted((r.kind, r.node) for r in rows) == sorted((str(k), n) for k in range(40) for n in range(2 + k % 2)) and max(r.calls for r in rows) == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the tables")
@pytest.mark.parametrize("name", ["gra15", "gra17", "gra19", "gra21"])
def test_graphs_of_orders_take_one_shuffle(spark, name):
    import __spark_entry__ as entry
    from factweave.shared import shared_dir

    before = len(os.listdir(shared_dir(spark).removeprefix("file:")))
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and len(os.listdir(shared_dir(spark).removeprefix("file:"))) == before
