"""Control-flow queries over functions with loops, handlers, nested choices and dead code, one for each part.

What is expected of each function stands beside it: the output of the operators at first writing, read through by hand.
"""

from __future__ import annotations

import functools

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import flow, lowering
from ..shared import spread
from .base import query, table

CASES = {'loop':'''def f(a, n):
    i = 0
    while i < n:
        if a:
            i = i + 1
        else:
            break
    else:
        a = 2
    return i
''','dead':'''def f(a):
    x = 1
    x = 2
    if 0:
        y = a
        return y
    return x
    z = 3
''','guard':'''def f(a):
    try:
        x = 1
    except ValueError:
        x = a
    try:
        y = g(x)
    except KeyError as e:
        y = e
    return y
''','each':'''def f(items):
    total = 0
    for item in items:
        if item:
            continue
        total = total + item
    return total
''','nest':'''def f(a, b):
    if a:
        if b:
            c = 1
        else:
            c = 2
    else:
        c = 3
    return c
''','forever':'''def f(q):
    while True:
        v = q
        if v:
            return v
''','fold':'''def f(a):
    k = 2 * 3 + 1
    t = 4
    u = t
    if 2 > 1:
        a = k + 1
    else:
        a = 0
    return a
'''}

#: Recorded and reviewed, by function: blocks where versions of a variable meet.
_PHIS = {
    "loop": [(3, 'i')],
    "dead": [],
    "guard": [(6, 'x'), (10, 'y')],
    "each": [(3, 'total')],
    "nest": [(8, 'c'), (10, 'c')],
    "forever": [],
    "fold": [(6, 'a')],
}

#: Heads and blocks of loops.
_LOOPS = {
    "loop": [(3, 3), (3, 5), (3, 6), (3, 7), (3, 9)],
    "dead": [],
    "guard": [],
    "each": [(3, 3), (3, 5), (3, 6), (3, 7), (3, 8), (3, 9)],
    "nest": [],
    "forever": [(3, 3), (3, 5), (3, 6), (3, 8), (3, 9)],
    "fold": [],
}

#: Definitions that nothing needs.
_DEAD = {
    "loop": [(10, 'a')],
    "dead": [(2, 'x')],  # x = 1 before x = 2
    "guard": [],
    "each": [],
    "nest": [],
    "forever": [],
    "fold": [(2, 'u')],
}

#: Predecessor, block, variable, version read and written.
_COPIES = {
    "loop": [(2, 3, 'i', 1, 2), (9, 3, 'i', 3, 2)],
    "dead": [],
    "guard": [(4, 6, 'x', 1, 3), (5, 6, 'x', 2, 3), (8, 10, 'y', 1, 3), (9, 10, 'y', 2, 3)],
    "each": [(2, 3, 'total', 1, 2), (7, 3, 'total', 2, 2), (9, 3, 'total', 3, 2)],
    "nest": [(6, 8, 'c', 1, 3), (7, 8, 'c', 2, 3), (8, 10, 'c', 3, 5), (9, 10, 'c', 4, 5)],
    "forever": [],
    "fold": [(4, 6, 'a', 2, 4), (5, 6, 'a', 3, 4)],
}

#: Edges without those that cannot be taken; with folded branches; blocks and code with both.
_KILLED = {
    "loop": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 5, 'true'), (3, 10, 'false'), (4, 1, 'return'), (5, 6, 'normal'), (6, 7, 'true'), (6, 8, 'false'), (7, 9, 'normal'), (8, 4, 'break'), (9, 3, 'normal'), (10, 4, 'normal')],
    "dead": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 4, 'true'), (3, 5, 'false'), (4, 1, 'return'), (5, 6, 'normal'), (6, 1, 'return')],
    "guard": [(0, 2, 'entry'), (2, 4, 'normal'), (4, 6, 'normal'), (6, 8, 'normal'), (7, 9, 'normal'), (8, 7, 'error'), (8, 10, 'normal'), (9, 10, 'normal'), (10, 1, 'return')],
    "each": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 5, 'true'), (3, 10, 'false'), (4, 1, 'return'), (5, 6, 'normal'), (6, 7, 'true'), (6, 8, 'false'), (7, 3, 'continue'), (8, 9, 'normal'), (9, 3, 'normal'), (10, 4, 'normal')],
    "nest": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 4, 'true'), (3, 9, 'false'), (4, 5, 'normal'), (5, 6, 'true'), (5, 7, 'false'), (6, 8, 'normal'), (7, 8, 'normal'), (8, 10, 'normal'), (9, 10, 'normal'), (10, 1, 'return')],
    "forever": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 5, 'true'), (5, 6, 'normal'), (6, 7, 'true'), (6, 8, 'false'), (7, 1, 'return'), (8, 9, 'normal'), (9, 3, 'normal')],
    "fold": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 4, 'true'), (3, 5, 'false'), (4, 6, 'normal'), (5, 6, 'normal'), (6, 1, 'return')],
}
_FOLDED = {
    "loop": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 6, 'true'), (3, 10, 'false'), (4, 1, 'return'), (6, 7, 'true'), (6, 8, 'false'), (7, 3, 'normal'), (8, 4, 'break'), (10, 4, 'normal')],
    "dead": [(0, 2, 'entry'), (2, 1, 'return')],
    "guard": [(0, 4, 'entry'), (3, 5, 'normal'), (4, 3, 'error'), (4, 8, 'normal'), (5, 8, 'normal'), (7, 9, 'normal'), (8, 7, 'error'), (8, 10, 'normal'), (9, 10, 'normal'), (10, 1, 'return')],
    "each": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 4, 'false'), (3, 6, 'true'), (4, 1, 'return'), (6, 7, 'true'), (6, 9, 'false'), (7, 3, 'continue'), (9, 3, 'normal')],
    "nest": [(0, 3, 'entry'), (3, 5, 'true'), (3, 9, 'false'), (5, 6, 'true'), (5, 7, 'false'), (6, 10, 'normal'), (7, 10, 'normal'), (9, 10, 'normal'), (10, 1, 'return')],
    "forever": [(0, 5, 'entry'), (5, 6, 'normal'), (6, 5, 'false'), (6, 7, 'true'), (7, 1, 'return')],
    "fold": [(0, 2, 'entry'), (2, 3, 'normal'), (3, 4, 'true'), (3, 5, 'false'), (4, 6, 'normal'), (5, 6, 'normal'), (6, 1, 'return')],
}
_SIMPLE = {
    "loop": [(0, ''), (1, ''), (2, 'i = 0'), (3, 'i < n'), (4, 'return i'), (6, 'a'), (7, 'i = i + 1'), (8, 'break'), (10, 'a = 2')],
    "dead": [(0, ''), (1, ''), (2, 'x = 1; x = 2; return x')],
    "guard": [(0, ''), (1, ''), (4, 'x = 1; y = g(x)'), (7, ''), (9, 'y = e'), (10, 'return y')],
    "each": [(0, ''), (1, ''), (2, 'total = 0'), (3, 'item in items'), (4, 'return total'), (6, 'item'), (7, 'continue'), (9, 'total = total + item')],
    "nest": [(0, ''), (1, ''), (3, 'a'), (5, 'b'), (6, 'c = 1'), (7, 'c = 2'), (9, 'c = 3'), (10, 'return c')],
    "forever": [(0, ''), (1, ''), (5, 'v = q'), (6, 'v'), (7, 'return v')],
    "fold": [(0, ''), (1, ''), (2, 'k = 2 * 3 + 1; t = 4; u = t'), (3, '2 > 1'), (4, 'a = k + 1'), (5, 'a = 0'), (6, 'return a')],
}

#: Variables that are assigned wherever a block begins, and that are needed where it ends.
_ASSIGNED = {
    "loop": [(1, 'a'), (1, 'i'), (1, 'n'), (2, 'a'), (2, 'n'), (3, 'a'), (3, 'i'), (3, 'n'), (4, 'a'), (4, 'i'), (4, 'n'), (5, 'a'), (5, 'i'), (5, 'n'), (6, 'a'), (6, 'i'), (6, 'n'), (7, 'a'), (7, 'i'), (7, 'n'), (8, 'a'), (8, 'i'), (8, 'n'), (9, 'a'), (9, 'i'), (9, 'n'), (10, 'a'), (10, 'i'), (10, 'n')],
    "dead": [(1, 'a'), (1, 'x'), (2, 'a'), (3, 'a'), (3, 'x'), (4, 'a'), (4, 'x'), (5, 'a'), (5, 'x'), (6, 'a'), (6, 'x')],
    "guard": [(1, 'a'), (1, 'x'), (1, 'y'), (2, 'a'), (3, 'a'), (3, 'x'), (4, 'a'), (5, 'a'), (5, 'x'), (6, 'a'), (6, 'x'), (7, 'a'), (7, 'x'), (7, 'y'), (8, 'a'), (8, 'x'), (9, 'a'), (9, 'x'), (9, 'y'), (10, 'a'), (10, 'x'), (10, 'y')],
    "each": [(1, 'item'), (1, 'items'), (1, 'total'), (2, 'items'), (3, 'items'), (3, 'total'), (4, 'item'), (4, 'items'), (4, 'total'), (5, 'item'), (5, 'items'), (5, 'total'), (6, 'item'), (6, 'items'), (6, 'total'), (7, 'item'), (7, 'items'), (7, 'total'), (8, 'item'), (8, 'items'), (8, 'total'), (9, 'item'), (9, 'items'), (9, 'total'), (10, 'item'), (10, 'items'), (10, 'total')],
    "nest": [(1, 'a'), (1, 'b'), (1, 'c'), (2, 'a'), (2, 'b'), (3, 'a'), (3, 'b'), (4, 'a'), (4, 'b'), (5, 'a'), (5, 'b'), (6, 'a'), (6, 'b'), (7, 'a'), (7, 'b'), (8, 'a'), (8, 'b'), (8, 'c'), (9, 'a'), (9, 'b'), (10, 'a'), (10, 'b'), (10, 'c')],
    "forever": [(1, 'q'), (1, 'v'), (2, 'q'), (3, 'q'), (5, 'q'), (6, 'q'), (6, 'v'), (7, 'q'), (7, 'v'), (8, 'q'), (8, 'v'), (9, 'q'), (9, 'v')],
    "fold": [(1, 'a'), (1, 'k'), (1, 't'), (1, 'u'), (2, 'a'), (3, 'a'), (3, 'k'), (3, 't'), (3, 'u'), (4, 'a'), (4, 'k'), (4, 't'), (4, 'u'), (5, 'a'), (5, 'k'), (5, 't'), (5, 'u'), (6, 'a'), (6, 'k'), (6, 't'), (6, 'u')],
}
_NEEDED = {
    "loop": [(0, 'a'), (0, 'n'), (2, 'a'), (2, 'i'), (2, 'n'), (3, 'a'), (3, 'i'), (3, 'n'), (5, 'a'), (5, 'i'), (5, 'n'), (6, 'a'), (6, 'i'), (6, 'n'), (7, 'a'), (7, 'i'), (7, 'n'), (8, 'i'), (9, 'a'), (9, 'i'), (9, 'n'), (10, 'i')],
    "dead": [(0, 'a'), (2, 'a'), (2, 'x'), (3, 'a'), (3, 'x'), (5, 'x')],
    "guard": [(0, 'KeyError'), (0, 'ValueError'), (0, 'a'), (0, 'g'), (2, 'KeyError'), (2, 'ValueError'), (2, 'a'), (2, 'g'), (3, 'KeyError'), (3, 'ValueError'), (3, 'a'), (3, 'g'), (4, 'KeyError'), (4, 'ValueError'), (4, 'a'), (4, 'g'), (4, 'x'), (5, 'KeyError'), (5, 'g'), (5, 'x'), (6, 'KeyError'), (6, 'g'), (6, 'x'), (7, 'KeyError'), (8, 'KeyError'), (8, 'y'), (9, 'y')],
    "each": [(0, 'items'), (2, 'items'), (2, 'total'), (3, 'item'), (3, 'items'), (3, 'total'), (5, 'item'), (5, 'items'), (5, 'total'), (6, 'item'), (6, 'items'), (6, 'total'), (7, 'items'), (7, 'total'), (8, 'item'), (8, 'items'), (8, 'total'), (9, 'items'), (9, 'total'), (10, 'total')],
    "nest": [(0, 'a'), (0, 'b'), (2, 'a'), (2, 'b'), (3, 'b'), (4, 'b'), (6, 'c'), (7, 'c'), (8, 'c'), (9, 'c')],
    "forever": [(0, 'q'), (2, 'q'), (3, 'q'), (5, 'q'), (5, 'v'), (6, 'q'), (6, 'v'), (8, 'q'), (9, 'q')],
    "fold": [(2, 'k'), (3, 'k'), (4, 'a'), (5, 'a')],
}

#: Definitions and uses; deciding and dependent blocks.
_DATA = {
    "loop": [(0, 3, 'n'), (0, 6, 'a'), (2, 3, 'i'), (2, 4, 'i'), (2, 7, 'i'), (7, 3, 'i'), (7, 4, 'i'), (7, 7, 'i')],
    "dead": [(0, 4, 'a'), (2, 6, 'x')],
    "guard": [(0, 5, 'a'), (4, 8, 'x'), (5, 8, 'x'), (8, 10, 'y'), (9, 10, 'y')],
    "each": [(0, 3, 'items'), (2, 4, 'total'), (2, 9, 'total'), (3, 6, 'item'), (3, 9, 'item'), (9, 4, 'total'), (9, 9, 'total')],
    "nest": [(0, 3, 'a'), (0, 5, 'b'), (6, 10, 'c'), (7, 10, 'c'), (9, 10, 'c')],
    "forever": [(0, 5, 'q'), (5, 6, 'v'), (5, 7, 'v')],
    "fold": [(2, 4, 'k'), (4, 6, 'a'), (5, 6, 'a')],
}
_CONTROL = {
    "loop": [(3, 5, 'true'), (3, 6, 'control'), (3, 10, 'false'), (6, 3, 'control'), (6, 7, 'true'), (6, 8, 'false'), (6, 9, 'control')],
    "dead": [(3, 4, 'true'), (3, 5, 'false'), (3, 6, 'control')],
    "guard": [(4, 3, 'error'), (4, 5, 'control'), (8, 7, 'error'), (8, 9, 'control')],
    "each": [(3, 3, 'control'), (3, 5, 'true'), (3, 6, 'control'), (6, 7, 'true'), (6, 8, 'false'), (6, 9, 'control')],
    "nest": [(3, 4, 'true'), (3, 5, 'control'), (3, 8, 'control'), (3, 9, 'false'), (5, 6, 'true'), (5, 7, 'false')],
    "forever": [(6, 3, 'control'), (6, 5, 'control'), (6, 6, 'control'), (6, 8, 'false'), (6, 9, 'control')],
    "fold": [(3, 4, 'true'), (3, 5, 'false')],
}

_CHANGED = {"dead": "def f(a):\n    x = 1\n    x = 2\n    return x", "fold": "def f(a):\n    k = 7\n    a = k + 1\n    return a"}
NAMES = list(CASES)


def files(spark, sf_dir):
    """(file_id, text): each part has one of the functions."""
    texts = spark.createDataFrame([(k, CASES[n]) for k, n in enumerate(NAMES)], "k long, text string")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), (F.col("p_partkey") % len(NAMES)).alias("k"))
    return p.join(F.broadcast(texts), "k").select("file_id", "text")


def _sql(facts: dict, columns: str) -> str:
    rows = ", ".join(f"({k}, {', '.join(repr(v) for v in r)})" for k, n in enumerate(NAMES) for r in facts[n])
    return f"SELECT p_partkey AS file_id, {columns} FROM part JOIN (VALUES {rows}) AS e(k, {columns}) ON p_partkey % {len(NAMES)} = e.k"


def _query(name: str, facts: dict, columns: str, build) -> None:
    @query(name, _sql(facts, columns))
    def one(spark, sf_dir):
        return build(files(spark, sf_dir)).drop("func")


_I, _S = pa.int32(), pa.string()
_per = lambda facts, columns: lambda files: flow.per_function(files, facts, columns)
_EDGE = {"src": _I, "dst": _I, "label": _S}
_query("flw03", _KILLED, "src, dst, label", _per(lambda f: lowering.kill_edges(f).edges, _EDGE))
_query("flw04", _FOLDED, "src, dst, label", _per(lambda f: lowering.fold_branches(f).edges, _EDGE))
_query("flw06", _SIMPLE, "block, code", _per(lambda f: [(b, "; ".join(s.code.get(b, []))) for s in [lowering.simplify(f)] for b in s.kind], {"block": _I, "code": _S}))
_query("flw05", {n: [(b,) for b, _ in r] for n, r in _SIMPLE.items()}, "block", _per(lambda f: [(b,) for b in lowering.simplify(f).kind], {"block": _I}))
_query("flw07", _PHIS, "block, var", flow.ssa)
_query("flw08", _COPIES, "pred, block, var, reads, writes", _per(lowering.copies, {"pred": _I, "block": _I, "var": _S, "reads": _I, "writes": _I}))
_query("flw10", _LOOPS, "head, block", flow.loops)
_query("opt02", _DEAD, "block, var", flow.liveness)
_query("opt04_forward", _ASSIGNED, "block, var", _per(lowering.assigned, {"block": _I, "var": _S}))
_query("opt04_backward", _NEEDED, "block, var", _per(lowering.needed, {"block": _I, "var": _S}))
_query("ddg01_bodies", _DATA, "src, dst, var", flow.data)
_query("cdg01_bodies", _CONTROL, "src, dst, label", flow.control)


@query("opt03", _sql({n: [(_CHANGED[n].replace("\n", "|"),)] if n in _CHANGED else [] for n in NAMES}, "text"))
def simplified(spark, sf_dir):
    """Sources that folding and dead stores change, one line of text with bars for line ends."""

    def run(it):
        told = functools.lru_cache(flow.REMEMBERED)(lowering.simplified)  # equal sources are worked out once
        for batch in it:
            ids, texts = (batch.column(k).to_pylist() for k in range(2))
            rows = [(i, new.replace("\n", "|")) for i, t in zip(ids, texts, strict=True) if (new := told(t)) != t.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _S)], names=["file_id", "text"])

    return spread(files(spark, sf_dir), "file_id").mapInArrow(run, "file_id long, text string")


_ORDERED = "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey"


@query("gra29", f"SELECT l_orderkey AS order_id, CAST(CASE WHEN n = 1 THEN 0 WHEN l_orderkey % 2 = 0 THEN n - 1 ELSE n + 1 END AS BIGINT) AS copies, array_to_string(CASE WHEN l_orderkey % 2 = 0 THEN list_concat(generate_series(2, n), [n]) ELSE list_concat(generate_series(2, n), [1]) END, ' ') AS held FROM ({_ORDERED})")
def parallel_copies(spark, sf_dir):
    """Lines of an order take the place of the one before all at once: a chain, or a cycle in odd orders. The copies, and what running them gives."""

    def run(it):
        for frame in it:
            out = []
            for key, lines in zip(frame["order_id"], frame["lines"], strict=True):
                n = len(lines)
                steps = lowering.sequential({k: k + 1 if k < n else k if key % 2 == 0 else 1 for k in range(1, n + 1)})
                held = {k: k for k in range(1, n + 1)}
                for d, s in steps:
                    held[d] = held[s]
                out.append((key, len(steps), " ".join(str(held[k]) for k in range(1, n + 1))))
            yield pd.DataFrame(out, columns=["order_id", "copies", "held"])

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_set("l_linenumber").alias("lines"))  # at most seven lines
    return lines.mapInPandas(run, "order_id long, copies long, held string")
