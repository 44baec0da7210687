"""Dataflow with predicates: which predicates stand over others, and loads that a store already answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import graph
from .fixpoint import fixpoint


def predicates(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph, pred, over): the predicate graph's dominators; whenever pred holds, so do all in over, from the root to itself."""
    return graph.dominator_paths(edges, roots).select("graph", F.col("node").alias("pred"), F.col("path").alias("over"))


def answered(loads: DataFrame, stores: DataFrame, over: DataFrame) -> DataFrame:
    """(graph, dst, src): the value that a load gives is the one that a store has put there.

    loads (graph, dst, pred, obj, field, heap) and stores (graph, src, pred, obj, field, heap) meet on object, field and the heap
    version that one reads and the other leaves; the store's predicate must dominate the load's. If the value stored was
    itself such a load's, the chain is followed to its end, by doubling.
    """
    held = loads.join(over, ["graph", "pred"])
    met = held.join(stores.select("graph", "obj", "field", "heap", F.col("pred").alias("under"), "src"), ["graph", "obj", "field", "heap"]).filter(F.array_contains("over", F.col("under")))
    first = written(met.groupBy("graph", "dst").agg(F.min("src").alias("src")).filter("src <> dst"))
    while True:
        ahead = first.select("graph", F.col("dst").alias("src"), F.col("src").alias("next"))
        new = written(first.join(ahead, ["graph", "src"], "left").select("graph", "dst", F.when(F.col("next") == F.col("dst"), F.col("src")).otherwise(F.coalesce("next", "src")).alias("src")))
        if new.join(first, ["graph", "dst", "src"], "left_anti").isEmpty():
            return first
        first = new


def constants(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(node, value): what a variable surely is where a node of edges (src, dst) begins.

    assigned (node, value) says which nodes set it; all others pass on what comes. Values meet where paths meet: two
    different ones are none. A way on which nothing is assigned says nothing.
    """
    passing = edges.join(assigned.select(F.col("node").alias("src")).distinct(), "src", "left_anti")
    seed = edges.join(assigned.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "value")
    came = fixpoint(seed, lambda d, _: d.join(passing, d["node"] == passing["src"]).select(F.col("dst").alias("node"), "value"))[0]
    return came.groupBy("node").agg(F.min("value").alias("value"), F.max("value").alias("most")).filter("value = most").drop("most")
