"""What fixpoints between functions write: a few tables for each function of a chain, however the calls are levelled."""

import os

from factweave.operators import interproc
from factweave.operators.fixpoint import fixpoint
from factweave.shared import shared_dir
from factweave.sources.flows import flow_facts


def chain(spark, n):
    make, fns = spark.createDataFrame, [f"f{k}" for k in range(n)]
    formals = make([(f, p, f"{f}.{s}") for f in fns for p, s in ((0, "a"), (-1, "r"))], "fn string, pos int, slot string")
    actuals = make([(f"{f}/0", p, f"{f}.{s}") for f in fns[:-1] for p, s in ((0, "a"), (-1, "r"))], "site string, pos int, slot string")
    return fns, formals, actuals, make([(fns[-1], f"{fns[-1]}.a", f"{fns[-1]}.r")], "fn string, src string, dst string")


def tables(spark):
    return len(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_summaries_write_little(spark):
    fns, formals, actuals, flows = chain(spark, 6)
    calls = spark.createDataFrame([(a, f"{a}/0", b) for a, b in zip(fns, fns[1:], strict=False)], "fn string, site string, target string")
    before = tables(spark)
    assert {tuple(r) for r in interproc.summaries(flows, calls, actuals, formals).collect()} == {(f, 0, -1) for f in fns}
    assert tables(spark) - before <= 4 * len(fns) + 6


def test_top_down_writes_little(spark):
    fns, formals, actuals, flows = chain(spark, 6)
    calls = spark.createDataFrame([(f, f"{f}/0", f"{f}.n") for f in fns], "fn string, site string, slot string")
    refs = spark.createDataFrame([(a, f"{a}.n", b) for a, b in zip(fns, fns[1:], strict=False)], "fn string, slot string, target string")
    before = tables(spark)
    edges = interproc.top_down(flows, refs, calls, actuals, formals, spark.createDataFrame([("f0",)], "fn string"))[1]
    assert {tuple(r) for r in edges.collect()} == {(a, f"{a}/0", b) for a, b in zip(fns, fns[1:], strict=False)}
    assert tables(spark) - before <= 8 * len(fns) + 6


def test_rounds_of_many_and_of_few_rows(spark, monkeypatch):
    step = lambda d, _: d.selectExpr("(n * 3 + 1) % 50 as n").union(d.selectExpr("(n * 2) % 50 as n"))
    got = []
    for few in (0, 3, 100_000):
        monkeypatch.setattr("factweave.operators.fixpoint.FEW", few)
        rows, rounds, done = fixpoint(spark.createDataFrame([(1,)], "n int"), step)
        got.append((sorted(r.n for r in rows.collect()), rounds, done))
    assert got[0] == got[1] == got[2] and len(set(got[0][0])) == len(got[0][0])


def test_sources_are_dealt_to_tasks(spark):
    files = spark.createDataFrame([(str(k), "main.py", "x = 1\n") for k in range(40)], "project string, path string, text string").coalesce(1)
    assert flow_facts(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
