"""Components and spanning forests go on with what is left between trees: few rows are written, and old rounds' edges are deleted."""

import os
import random

from factweave import shared
from factweave.operators import graph
from factweave.plans import shapes


def small_graphs(spark):
    rng = random.Random(5)
    rows = [(g * 10 + j, g * 10 + k, rng.randrange(9)) for g in range(60) for j in range(6) for k in (j + 1, j + 2)]
    return rows, spark.createDataFrame(rows, "src long, dst long, weight long")


def test_forest_writes_few_rows(spark, monkeypatch):
    rows, edges = small_graphs(spark)
    whole, sizes = shared.stored, []

    def counting(df):
        path = whole(df)
        sizes.append(spark.read.parquet(path).count())
        return path

    monkeypatch.setattr(shared, "stored", counting)
    label, want = {}, []
    find = lambda x: x if label.get(x, x) == x else find(label[x])
    for a, b, w in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if find(a) != find(b):
            label[find(a)] = find(b)
            want.append((a, b, w))
    assert sorted(map(tuple, graph.spanning_tree(edges).collect())) == sorted(want)
    assert sum(sizes) <= 6 * len(rows)


def test_old_edges_are_deleted(spark):
    _, edges = small_graphs(spark)
    before = set(os.listdir(shared.shared_dir(spark)))
    found = graph.components(edges)
    left = [n for n in set(os.listdir(shared.shared_dir(spark))) - before if spark.read.parquet(f"{shared.shared_dir(spark)}/{n}").columns == ["src", "dst"]]
    assert len(left) == 1 and found.select("component").distinct().count() == 60


def test_regions_are_of_parts_only(spark, tmp_path, monkeypatch):
    lines = [(1, 5), (1, 3), (1, 4), (2, 4), (2, 9), (3, 7), (None, 8), (None, 3), (4, 7), (4, 6)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e, alone=None: (seen.extend(map(tuple, e.collect())), whole(e, alone))[1])
    assert sorted(map(tuple, shapes.regions(spark, str(tmp_path)).collect())) == [(3, 3), (4, 3), (5, 3), (6, -1), (7, -1), (8, -1), (9, 3)]
    assert sorted(seen) == [(3, 4), (3, 5), (4, 9), (6, 7)]
