"""Dominators of many graphs, exclusion, load elimination under predicates, cloning and deferred switches against brute force."""

import itertools
import random

from factweave.operators import cloning, dataflow, graph, pointsto


def dominates(edges, root, x, n):
    """Whether all paths from the root to n lead over x; None if there is none."""

    def reach(without):
        seen, todo = set(), [root] if root != without else []
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [d for s, d in edges if s == v and d != without]
        return seen

    return None if n not in reach(None) else x == n or n not in reach(x)


def random_graphs(seed, graphs=25, n=8):
    rng = random.Random(seed)
    return {g: {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(3, 16))} | {(0, 1)} for g in range(graphs)}


def test_dominator_paths(spark):
    graphs = random_graphs(1)
    rows = [(g, s, d) for g, e in graphs.items() for s, d in e]
    got = {(r.graph, r.node): list(r.path) for r in graph.dominator_paths(spark.createDataFrame(rows, "graph int, src int, dst int"), spark.createDataFrame([(g, 0) for g in graphs], "graph int, node int")).collect()}
    for g, e in graphs.items():
        for n in range(8):
            doms = [x for x in range(8) if dominates(e, 0, x, n)]
            assert sorted(got.get((g, n), [])) == doms
            if doms:
                path = got[g, n]
                assert path[0] == 0 and path[-1] == n and all(dominates(e, 0, a, b) for a, b in itertools.pairwise(path))


#: Graphs by their edges, sets that are exclusive and sets that are not.
EXCLUSIVE = [
    ("a>b a>c b>d c>d", ["bc"], ["ab", "ac", "ad", "bd", "cd", "abc", "bcd", "abcd"]),
    ("a>b a>c b>d b>e", ["bc", "de", "cd", "ce", "cde"], ["ab", "ac", "ad", "ae"]),
    ("a>b a>c b>d b>e c>f c>g d>h e>h f>i g>i h>j i>j", ["bc", "de", "fg", "hi", "defg", "dei", "fgh", "bi", "ch"], ["fgi", "deh", "bh", "ci"]),
    ("a>b a>c a>d b>d c>d", ["bc"], ["bd", "cd"]),
    ("a>b a>c b>a", [], ["bc", "ab"]),
]


def paths_meet(edges, nodes):
    """Whether some walk leads over two of the nodes."""
    reach = lambda v: {d for s, d in edges if s == v}
    for a in nodes:
        seen, todo = set(), list(reach(a))
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += reach(v)
        if seen & (set(nodes) - {a}):
            return True
    return False


def test_exclusive(spark):
    edges, sets, want = [], [], {}
    for g, (text, yes, no) in enumerate(EXCLUSIVE):
        edges += [(g, *e.split(">")) for e in text.split()]
        for group, answer in [*((s, True) for s in yes), *((s, False) for s in no)]:
            sets += [(g, group, n) for n in group]
            want[g, group] = answer
    rng = random.Random(2)
    for g, e in random_graphs(3).items():
        edges += [(100 + g, str(s), str(d)) for s, d in e if s != d]
        group = rng.sample(range(8), 3)
        sets += [(100 + g, "s", str(n)) for n in group]
        want[100 + g, "s"] = not paths_meet({(s, d) for s, d in e if s != d}, group)
    got = graph.exclusive(spark.createDataFrame(edges, "graph int, src string, dst string"), spark.createDataFrame(sets, "graph int, set string, node string"))
    assert {(r.graph, r.set): r.exclusive for r in got.collect()} == want


def test_answered_loads(spark):
    """x.f = v under a predicate, read under others: hand-derived."""
    edges = [(0, "entry", "p"), (0, "entry", "q"), (0, "p", "pp"), (0, "p", "r"), (0, "q", "r")]
    over = dataflow.predicates(spark.createDataFrame(edges, "graph int, src string, dst string"), spark.createDataFrame([(0, "entry")], "graph int, node string"))
    assert {r.pred: list(r.over) for r in over.collect()} == {"entry": ["entry"], "p": ["entry", "p"], "q": ["entry", "q"], "pp": ["entry", "p", "pp"], "r": ["entry", "r"]}
    stores = [(0, "v", "p", "x", "f", 1), (0, "w", "entry", "x", "g", 1), (0, "l1", "pp", "y", "f", 1)]
    loads = [
        (0, "l1", "pp", "x", "f", 1),  # under the store: v
        (0, "l2", "r", "x", "f", 1),  # the store may not have run
        (0, "l3", "r", "x", "g", 1),  # stored at the entry: w
        (0, "l4", "pp", "x", "g", 2),  # another heap version
        (0, "l5", "pp", "y", "f", 1),  # stored from l1, so v
        (0, "l6", "pp", "z", "f", 1),
    ]
    kinds = "graph int, {} string, pred string, obj string, field string, heap int"
    got = dataflow.answered(spark.createDataFrame(loads, kinds.format("dst")), spark.createDataFrame(stores, kinds.format("src")), over)
    assert {(r.dst, r.src) for r in got.collect()} == {("l1", "v"), ("l3", "w"), ("l5", "v")}


def test_shared_code(spark):
    for seed in range(3):
        rng = random.Random(seed)
        ctx = {c: (rng.choice("fgh"), rng.choice("xy")) for c in range(40)}
        calls = {(c, rng.randrange(2), rng.randrange(40)) for c in ctx for _ in range(rng.randrange(3))}
        group = dict(ctx)
        while True:
            new = {c: (group[c], frozenset((op, group[d]) for a, op, d in calls if a == c)) for c in ctx}
            if len(set(new.values())) == len(set(group.values())):
                break
            ids = {v: k for k, v in enumerate(dict.fromkeys(new.values()))}
            group = {c: ids[v] for c, v in new.items()}
        want = {(c, ctx[c][0], min(d for d in ctx if group[d] == group[c])) for c in ctx}
        got = cloning.shared_code(spark.createDataFrame([(c, *v) for c, v in ctx.items()], "ctx int, code string, facts string"), spark.createDataFrame(list(calls), "ctx int, op int, callee int"))
        assert {tuple(r) for r in got.collect()} == want


def test_deferred_switches(spark):
    make = spark.createDataFrame
    alloc = [("c", "yes"), ("s", "a"), ("t", "b"), ("u", "maybe"), ("m", "n1"), ("m", "s1")]
    branches = [("c", True, "s", "d"), ("c", False, "t", "d"), ("d", False, "t", "e"), ("u", True, "s", "g"), ("u", False, "t", "g")]
    truths = [("yes", True), ("a", True), ("b", False), ("maybe", True), ("maybe", False)]
    types = [("m", "int", "i"), ("m", "str", "j"), ("m", "list", "k")]
    kinds = [("n1", "int"), ("s1", "str"), ("n2", "int")]
    run = lambda extra: {
        tuple(r) for r in pointsto.switched(make(alloc, "slot string, obj string"), make(extra, "src string, dst string"), make(truths, "obj string, truth boolean"), make(branches, "cond string, truth boolean, src string, dst string"), make(types, "cond string, kind string, dst string"), make(kinds, "obj string, kind string")).collect()
    } - set(alloc)
    once = {("d", "a"), ("g", "a"), ("g", "b"), ("i", "n1"), ("j", "s1")}
    assert run([("x", "y")]) == once  # behind the dead branch nothing appears
    assert run([("t", "c")]) == once | {("c", "b"), ("d", "b"), ("e", "b")}  # the condition turns: both branches, and the one behind


def test_constants(spark):
    """Against all paths of random graphs, up to a length that covers every pair of nodes."""
    for g, edges in random_graphs(7, graphs=6, n=6).items():
        assigned = {n: v for n, v in ((0, 1), (2, 1), (4, 2)) if n != g}
        came = {n: set() for n in range(6)}
        state = {(n, None) for n in range(6)}  # (node, value at its beginning)
        for _ in range(40):
            state |= {(d, assigned.get(n, v)) for n, v in state for s, d in edges if s == n}
        for n, v in state:
            if v is not None:
                came[n].add(v)
        want = {n: min(v) for n, v in came.items() if len(v) == 1}
        got = dataflow.constants(spark.createDataFrame(list(edges), "src int, dst int"), spark.createDataFrame(list(assigned.items()), "node int, value int"))
        assert {r.node: r.value for r in got.collect()} == want
