"""Inclusion-based points-to analysis as joins to a fixpoint, and what builds on it.

Relations: alloc(slot, obj), copy(src, dst), load(dst, base, field), store(base, field, src). A field of an object is a
slot of its own, named by object and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .fixpoint import fixpoint


def field_slot(obj: Column, field: Column) -> Column:
    return F.concat(F.lit("@"), obj, F.lit("."), field)


def solve(alloc: DataFrame, copy: DataFrame, load: DataFrame, store: DataFrame) -> DataFrame:
    """(slot, obj): what each slot may point to. All columns are strings.

    Each round propagates only new facts: along copies; at loads and stores a new object of the base makes a copy
    from or to its field, kept as a growing relation so that later facts flow along it too.
    """
    copies = written(copy.select("src", "dst").distinct())
    load, store = written(load.distinct()), written(store.distinct())
    facts = written(alloc.select("slot", "obj").distinct())
    delta, fresh = facts, copies
    while True:
        loads = delta.join(load, delta["slot"] == load["base"]).select(field_slot(F.col("obj"), F.col("field")).alias("src"), "dst")
        stores = delta.join(store, delta["slot"] == store["base"]).select("src", field_slot(F.col("obj"), F.col("field")).alias("dst"))
        fresh = written(loads.union(stores).distinct().join(copies, ["src", "dst"], "left_anti"))
        old = facts.join(fresh, facts["slot"] == fresh["src"]).select(F.col("dst").alias("slot"), "obj")
        new = delta.join(copies, delta["slot"] == copies["src"]).select(F.col("dst").alias("slot"), "obj")
        delta = written(old.union(new).distinct().join(facts, ["slot", "obj"], "left_anti"))
        copies = written(copies.union(fresh))
        if delta.isEmpty() and fresh.isEmpty():
            return facts
        facts = written(facts.union(delta))


def flow(alloc: DataFrame, copy: DataFrame) -> DataFrame:
    """(slot, obj) with assignments only: semi-naive along copies."""
    c = copy.select("src", "dst").distinct()
    return fixpoint(alloc.select("slot", "obj"), lambda d, _: d.join(c, d["slot"] == c["src"]).select(F.col("dst").alias("slot"), "obj"))[0]


def checks(pts: DataFrame, may_be_null: DataFrame, slots: DataFrame) -> DataFrame:
    """(slot, result): true where a slot may refer to something, false where it may be null; up to two rows."""
    yes = slots.join(pts.select("slot").distinct(), "slot", "left_semi").select("slot", F.lit(True).alias("result"))
    return yes.union(slots.join(may_be_null.select("slot").distinct(), "slot", "left_semi").select("slot", F.lit(False)))


def unresolved(pts: DataFrame, copy: DataFrame) -> DataFrame:
    """(slot): sources of copies that point to nothing and that no copy writes: root causes of empty results."""
    return copy.select(F.col("src").alias("slot")).distinct().join(pts.select("slot"), "slot", "left_anti").join(copy.select(F.col("dst").alias("slot")), "slot", "left_anti")


def callees(pts: DataFrame, calls: DataFrame) -> DataFrame:
    """(site, callee) of calls (site, slot): dynamic dispatch on what the slot points to."""
    return calls.join(pts, "slot").select("site", F.col("obj").alias("callee")).distinct()


def escape(pts: DataFrame, fields: DataFrame, returned: DataFrame, params: DataFrame, shared: DataFrame) -> DataFrame:
    """(obj, flags): 1 returned, 2 from a parameter, 4 global, passed on to what an object's fields (obj, inner) hold."""
    seed = returned.select("slot", F.lit(1).alias("flag")).union(params.select("slot", F.lit(2))).union(shared.select("slot", F.lit(4)))
    start = pts.join(seed, "slot").select("obj", "flag")
    f = fields.select(F.col("obj").alias("outer"), "inner").distinct()
    every = fixpoint(start, lambda d, _: d.join(f, d["obj"] == f["outer"]).select(F.col("inner").alias("obj"), "flag"))[0]
    return every.groupBy("obj").agg(F.bit_or("flag").alias("flags"))


def propagate(facts: DataFrame, invoke: DataFrame, killed: DataFrame) -> DataFrame:
    """(code, obj): a callee's facts reach its callers over invoke (src, op, dst), but for objects killed (src, op, obj) on
    that very edge."""
    k = killed.select(F.col("src").alias("ks"), F.col("op").alias("ko"), F.col("obj").alias("kobj")).distinct()
    i = invoke.select("src", "op", "dst").distinct()

    def step(d, _):
        came = d.join(i, d["code"] == i["dst"]).select("src", "op", "obj")
        return came.join(k, (came["src"] == k["ks"]) & (came["op"] == k["ko"]) & (came["obj"] == k["kobj"]), "left_anti").select(F.col("src").alias("code"), "obj")

    return fixpoint(facts.select("code", "obj"), step)[0]


def switched(alloc: DataFrame, copy: DataFrame, truths: DataFrame, branches: DataFrame, types: DataFrame, kinds: DataFrame) -> DataFrame:
    """(slot, obj) with deferred switches: what stands in a branch counts only once its condition may be so.

    branches (cond, truth, src, dst) are copies in a branch that is taken when the condition's slot may hold an object of
    that truth, truths (obj, truth); types (cond, kind, dst) pass on the objects of one kind, kinds (obj, kind). Branch copies join
    the growing relation of copies when their first condition arrives, and then all that their source holds flows.
    """
    named = lambda kind, a, b: [F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")]
    seed = alloc.select(*named("P", "slot", "obj")).unionByName(copy.select(*named("C", "src", "dst")))

    def step(d: DataFrame, every: DataFrame) -> DataFrame:
        holds = lambda f: f.filter("kind = 'P'").select("a", F.col("b").alias("obj"))
        copied = lambda f: f.filter("kind = 'C'").select("a", F.col("b").alias("dst"))
        went = holds(d).join(copied(every), "a").unionByName(holds(every).join(copied(d), "a")).select(*named("P", "dst", "obj"))
        arrived = holds(d).withColumnRenamed("a", "cond")
        opened = arrived.join(truths, "obj").select("cond", "truth").distinct().join(branches, ["cond", "truth"]).select(*named("C", "src", "dst"))
        sorted_ = arrived.join(kinds, "obj").join(types, ["cond", "kind"]).select(F.lit("P").alias("kind"), F.col("dst").alias("a"), F.col("obj").alias("b"))
        return went.unionByName(opened).unionByName(sorted_)

    return fixpoint(seed, step)[0].filter("kind = 'P'").select(F.col("a").alias("slot"), F.col("b").alias("obj"))
