"""Parsing makes only the nodes and columns that are asked for, and equal sources are worked out once."""

from __future__ import annotations

import pathlib

from pyspark.sql import functions as F

from factweave.operators import callgraph, flow, rules
from factweave.sources import python

LOOPS = "def f(q):\n    while q:\n        if q:\n            return q\n        q = 1\n\n\nclass A:\n    def g(self):\n        def h():\n            return 1\n        for x in h:\n            pass\n        return 2\n"


def test_kinds_are_a_part_of_all_nodes():
    for path in pathlib.Path(python.__file__).parents[1].rglob("*.py"):
        text = path.read_text()
        rows = python.node_rows(1, text)
        for kinds in (rules.KINDS, callgraph.KINDS, ("Name",), ("arg", "Call")):
            assert python.node_rows(1, text, frozenset(kinds)) == [r for r in rows if r[5] in kinds]


def test_columns_and_flows(spark):
    files = spark.createDataFrame([(1, LOOPS), (2, "f(a)\n"), (3, "f(")], "file_id long, text string")
    got = python.parse(files, ("Call", "FunctionDef"), ("file_id", "kind", "qualname"))
    assert got.columns == ["file_id", "kind", "qualname"]
    assert sorted(map(tuple, got.collect())) == [(1, "FunctionDef", "main.A.g"), (1, "FunctionDef", "main.A.g.h"), (1, "FunctionDef", "main.f"), (2, "Call", "f")]
    inside = flow.loops(files).select("file_id", "func", F.col("block").alias("src"))
    bad = flow.edges(files).filter("label = 'return'").join(inside, ["file_id", "func", "src"])
    want = flow.blocks(files).select("file_id", "func").distinct().join(bad, ["file_id", "func"], "left_anti")
    assert sorted(map(tuple, flow.inlinable(files).collect())) == sorted(map(tuple, want.collect()))
    assert list(flow.flows(LOOPS, False)) == ["main.f", "main.A.g", "main.A.g.h"]
