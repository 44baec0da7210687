"""Equal programs are worked out once, and every one of them gets the result."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import alike, interproc, pointcalls, storegraph
from factweave.plans import between


def test_classes(spark):
    rows = [(1, 1, "a"), (1, 2, None), (2, 2, None), (2, 1, "a"), (3, 1, None), (3, 2, "a"), (4, 1, "a"), (4, 1, "a"), (5, 1, "a"), (None, 1, "a")]
    members, firsts = alike.classes(spark.createDataFrame(rows, "k long, n int, t string"), "k", "n", "t")
    assert sorted(map(tuple, members.select("k", "like").collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert sorted(map(str, firsts.collect())) == sorted(str(r) for r in spark.createDataFrame([r for r in rows if r[0] in (1, 3, 4, 5)], firsts.schema).collect())


def test_equal_projects_are_parsed_once(spark, monkeypatch):
    seen = []

    def stub(facts):
        made = facts.filter("kind = 'function'").select("project", F.lit("main").alias("caller"), F.col("a").alias("callee"))
        seen.extend(r.project for r in made.collect())
        return made

    monkeypatch.setattr(pointcalls, "call_graph", stub)
    files = [(p, f, f"def {n}(): pass\n") for p, n in (("a", "x"), ("b", "x"), ("c", "y")) for f in ("m.py", "n.py")] + [("d", "m.py", "def x(): pass\n"), ("e", "m.py", None)]
    found = pointcalls.file_calls(spark.createDataFrame(files, "project string, path string, text string"))
    assert sorted(map(tuple, found.collect())) == [(p, "main", f"{m}.{n}") for p, n, ms in (("a", "x", "mn"), ("b", "x", "mn"), ("c", "y", "mn"), ("d", "x", "m")) for m in ms]
    assert sorted(seen) == ["a", "a", "c", "c", "d"]


@pytest.fixture()
def orders(spark, tmp_path):
    lines = [(p, j, "R", "F") for p in (-7, 10, 12) for j in (2, 3)] + [(5, 2, "R", "O"), (12, 3, "A", "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_equal_orders_are_worked_out_once(spark, orders, monkeypatch):
    seen = []

    def stub(flows, calls, actuals, formals):
        made = formals.select("fn").distinct().withColumn("i", F.lit(0)).withColumn("o", F.lit(-1))
        seen.extend(r.fn for r in made.collect())
        return made

    monkeypatch.setattr(interproc, "summaries", stub)
    assert sorted(r.fn for r in between.summaries(spark, orders).collect()) == ["-7.2", "-7.3", "10.2", "10.3", "12.2", "12.3", "5.2"]
    assert sorted(seen) == ["-7.2", "-7.3", "5.2"]


def test_names_of_regions(spark, orders, monkeypatch):
    stub = lambda allocs, copies, loads, stores: (allocs.withColumn("slot", F.concat(F.lit("@"), "obj", F.lit(".f"))), allocs.select("obj", F.col("obj").alias("region")))
    monkeypatch.setattr(storegraph, "solve", stub)
    assert sorted(map(tuple, between.store_graph(spark, orders).collect())) == [(f"@o{n}.f", f"o{n}", f"o{n}") for n in ("-7.2", "10.2", "12.2", "5.2")]
