"""A store graph: which objects slots hold, with regions of objects that no slot tells apart.

Objects spread by inclusion, regions by unification: objects that one slot holds are of one region, and a field is one slot
for each region. As regions merge, their field slots are renamed and what these held is held by the merged one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import graph
from .fixpoint import fixpoint


def solve(allocs: DataFrame, copies: DataFrame, loads: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, regions): (slot, obj) and (obj, region), the region named by its least object.

    allocs (slot, obj), copies (src, dst), loads (base, field, dst) and stores (base, field, src). A region's field slot is
    called ``@region.field``.
    """
    regions = written(allocs.select("obj").distinct().withColumn("region", F.col("obj")))
    held = written(allocs.select("slot", "obj").distinct())
    while True:
        spread = _spread(held, regions, copies, loads, stores)
        least = spread.groupBy("slot").agg(F.min("obj").alias("src"))
        together = spread.join(least, "slot").select("src", F.col("obj").alias("dst")).filter("src <> dst").unionByName(regions.filter("region <> obj").select(F.col("region").alias("src"), F.col("obj").alias("dst"))).distinct()
        merged = written(regions.select("obj").join(graph.components(written(together)).select(F.col("node").alias("obj"), F.col("component").alias("region")), "obj", "left").select("obj", F.coalesce("region", "obj").alias("region")))
        if merged.join(regions, ["obj", "region"], "left_anti").isEmpty():
            return spread, merged
        held, regions = _renamed(spread, regions, merged), merged


def _spread(held: DataFrame, regions: DataFrame, copies: DataFrame, loads: DataFrame, stores: DataFrame) -> DataFrame:
    """The inclusion fixpoint with regions as they are; rows (kind, a, b): slot a holds b, or a is copied to b."""
    fields = lambda f: F.concat(F.lit("@"), "region", F.lit("."), f)
    uses = loads.select(F.col("base").alias("a"), F.lit("load").alias("use"), "field", F.col("dst").alias("other")).unionByName(stores.select(F.col("base").alias("a"), F.lit("store").alias("use"), "field", F.col("src").alias("other")))
    seed = held.select(F.lit("P").alias("kind"), F.col("slot").alias("a"), F.col("obj").alias("b")).unionByName(copies.select(F.lit("C").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))

    def step(d: DataFrame, every: DataFrame) -> DataFrame:
        holds = lambda f: f.filter("kind = 'P'").select("a", F.col("b").alias("obj"))
        copied = lambda f: f.filter("kind = 'C'").select("a", F.col("b").alias("dst"))
        went = holds(d).join(copied(every), "a").unionByName(holds(every).join(copied(d), "a")).select(F.lit("P").alias("kind"), F.col("dst").alias("a"), F.col("obj").alias("b"))
        used = holds(d).join(uses, "a").join(regions, "obj").withColumn("place", fields("field"))
        load = F.col("use") == "load"
        return went.unionByName(used.select(F.lit("C").alias("kind"), F.when(load, F.col("place")).otherwise(F.col("other")).alias("a"), F.when(load, F.col("other")).otherwise(F.col("place")).alias("b")))

    return written(fixpoint(seed, step)[0].filter("kind = 'P'").select(F.col("a").alias("slot"), F.col("b").alias("obj")))


def _renamed(held: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Field slots of regions that have merged get the merged region's name."""
    moved = old.join(new.withColumnRenamed("region", "to"), "obj").filter("region <> to").select(F.col("region").alias("was"), "to").distinct()
    named = held.withColumn("was", F.when(F.col("slot").startswith("@"), F.regexp_extract("slot", r"^@(.*)\.[^.]*$", 1))).withColumn("field", F.when(F.col("was").isNotNull(), F.regexp_extract("slot", r"([^.]*)$", 1)))
    return written(named.join(moved, "was", "left").select(F.when(F.col("to").isNotNull(), F.concat(F.lit("@"), "to", F.lit("."), "field")).otherwise(F.col("slot")).alias("slot"), "obj").distinct())
