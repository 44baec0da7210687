"""Shape analysis: configurations of an object with reference counts and what is known of access paths, as columns.

A configuration says how many heap slots of each field refer to an object (``counts``, up to two, then many), which locals
do (``radius``), and which paths of a local and a field surely do (``hits``) or surely do not (``misses``). Paths of more than
one field are not kept: not to know them is always right. Paths are written ``local`` or ``local.field``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import graph

#: More than two.
MANY = 3
STATE = ["counts", "radius", "hits", "misses"]


def increment(counts: Column, slot: Column) -> Column:
    """The counts with one more reference from a slot."""
    own = F.least(F.coalesce(F.element_at(counts, slot), F.lit(0)) + 1, F.lit(MANY)).cast("int")
    return F.map_concat(F.map_filter(counts, lambda k, _: k != slot), F.create_map(slot, own))


def decrement(counts: Column, slot: Column) -> Column:
    """All counts there may be after one reference from a slot goes: many is two or many; none left drops the slot."""
    rest = F.map_filter(counts, lambda k, _: k != slot)
    n = F.coalesce(F.element_at(counts, slot), F.lit(0))
    with_n = lambda v: F.map_concat(rest, F.create_map(slot, F.lit(v)))
    return F.when(n == MANY, F.array(with_n(2), with_n(MANY))).when(n == 2, F.array(with_n(1))).otherwise(F.array(rest))


# Assignment


def _heap(path: Column) -> Column:
    return F.contains(path, F.lit("."))


def hit(path: Column) -> Column:
    """Whether a path refers to the configuration's object: true, false or null for maybe. A null path (of None) never does."""
    unreferenced = ~F.array_contains(F.map_keys("counts"), F.substring_index(path, ".", -1))
    heap = F.when(unreferenced | F.array_contains("misses", path), False).when(F.array_contains("hits", path), True)
    return F.when(path.isNull(), False).when(_heap(path), heap).otherwise(F.array_contains("radius", path))


def assign(configs: DataFrame, target: str, value: str) -> DataFrame:
    """The configurations after ``target = value`` (columns of paths; a null value is None).

    Where it is not known whether a path refers to the object, there is a row for either case, and a count that was many
    has two cases when it falls: one row may give up to four and more. Objects that nothing refers to any longer go.
    """
    keep = [c for c in configs.columns if c not in STATE]
    t, v = F.col(target), F.col(value)
    cases = lambda h: F.when(h.isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(h))
    split = configs.withColumn("_t", hit(t)).withColumn("_v", hit(v)).withColumn("_by_t", F.explode(cases(F.col("_t")))).withColumn("_by_v", F.explode(cases(F.col("_v"))))
    learned = lambda by, unsure, path: F.when(unsure.isNull() & by, F.array(path)).otherwise(F.array().cast("array<string>"))
    split = split.withColumn("hits", F.array_union("hits", F.array_union(learned(F.col("_by_t"), F.col("_t"), t), learned(F.col("_by_v"), F.col("_v"), v))))
    split = split.withColumn("misses", F.array_union("misses", F.array_union(learned(~F.col("_by_t"), F.col("_t"), t), learned(~F.col("_by_v"), F.col("_v"), v))))
    slot, heap = F.substring_index(t, ".", -1), _heap(t)
    changes = F.col("_by_t") != F.col("_by_v")
    gains = F.col("_by_v")
    counts = F.when(~changes | ~heap, F.array("counts")).when(gains, F.array(increment(F.col("counts"), slot))).otherwise(decrement(F.col("counts"), slot))
    radius = F.when(~changes | heap, F.col("radius")).when(gains, F.array_union("radius", F.array(t))).otherwise(F.array_remove("radius", t))
    # Where the target's slot changes, paths through it are no longer known: those of an assigned local, and of an assigned
    # field its hits if the target did refer to the object, its misses if not.
    through = lambda p: F.when(heap, F.substring_index(p, ".", -1) == slot).otherwise(F.substring_index(p, ".", 1) == t)
    lost = lambda stable: lambda p: ~(through(p) & (~heap | ~stable))
    hits = F.filter("hits", lost(~F.col("_by_t")))
    misses = F.filter("misses", lost(F.col("_by_t")))
    # What is stored is known of the target; fields of an assigned local are those of the local that was read.
    moved = lambda c: F.when(~heap & ~_heap(v), F.transform(F.filter(c, lambda p: (F.substring_index(p, ".", 1) == v) & (v != t)), lambda p: F.concat(t, F.lit("."), F.substring_index(p, ".", -1)))).otherwise(F.array().cast("array<string>"))
    stored = lambda by: F.when(heap & by, F.array(t)).otherwise(F.array().cast("array<string>"))
    new_hits = F.array_union(F.array_union(hits, F.coalesce(moved(hits), F.array().cast("array<string>"))), stored(F.col("_by_v")))
    new_misses = F.array_union(F.array_union(misses, F.coalesce(moved(misses), F.array().cast("array<string>"))), stored(~F.col("_by_v")))
    same = F.col("_by_t") & F.col("_by_v")
    out = split.select(*keep, F.explode(counts).alias("counts"), radius.alias("radius"), F.when(same, F.col("hits")).otherwise(new_hits).alias("hits"), F.when(same, F.col("misses")).otherwise(new_misses).alias("misses"))
    unused = lambda c: F.filter(c, lambda p: F.map_contains_key("counts", F.substring_index(p, ".", -1)))  # noqa: E731  of fields that no longer refer to it, nothing need be said
    out = out.select(*keep, "counts", F.array_sort("radius").alias("radius"), F.array_sort(F.array_distinct("hits")).alias("hits"), F.array_sort(F.array_distinct(unused("misses"))).alias("misses"))
    return out.filter((F.size(F.map_keys("counts")) > 0) | (F.size("radius") > 0) | (F.size("hits") > 0))


# Calls


def _written_out(counts: str, radius: str) -> Column:
    """A configuration's references in one text, for joins."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return F.concat(F.array_join(entries, ","), F.lit("|"), F.array_join(F.array_sort(F.col(radius)), ","))


def split(states: DataFrame, visible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(local, remote) of states (state, call, counts, radius) by what a call's callee sees, visible (call, slot).

    Remote configurations (call, key, counts, radius) are those parts of the references, each once a call; local ones
    (state, call, key, counts, radius) keep the rest and say which remote one they left for.
    """
    seen = visible.groupBy("call").agg(F.collect_set("slot").alias("seen"))
    known = states.join(seen, "call", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    inside = lambda k: F.array_contains("seen", k)
    parts = known.select(
        "state", "call", F.map_filter("counts", lambda k, _: inside(k)).alias("far"), F.filter("radius", inside).alias("far_radius"),
        F.map_filter("counts", lambda k, _: ~inside(k)).alias("counts"), F.filter("radius", lambda k: ~inside(k)).alias("radius"),
    ).withColumn("key", _written_out("far", "far_radius"))
    remote = parts.groupBy("call", "key").agg(F.first("far_radius").alias("radius"), F.first(F.map_entries("far")).alias("entries"))
    return parts.select("state", "call", "key", "counts", "radius"), remote.select("call", "key", F.map_from_entries("entries").alias("counts"), F.array_sort("radius").alias("radius"))


def merge(local: DataFrame, returned: DataFrame) -> DataFrame:
    """States (state, call, counts, radius) after calls: every local part with each outcome (call, key, counts, radius) of its remote part."""
    came = returned.select("call", "key", F.col("counts").alias("far"), F.col("radius").alias("far_radius"))
    return local.join(came, ["call", "key"]).select("state", "call", F.map_concat("counts", "far").alias("counts"), F.array_sort(F.array_union("radius", "far_radius")).alias("radius"))


# Path information


def meet(paths: DataFrame, points: DataFrame) -> DataFrame:
    """(point, class, path, hit): what all predecessors of a point agree on.

    paths (state, path, class, hit) have must-alias classes of access paths, points (point, state) the predecessors. Two
    paths stay in one class where they are in all of them, so partitions are intersected; a hit that is not the same
    everywhere is null for maybe. A class is named by its least path; paths that a predecessor does not know are alone there
    and need not be listed.
    """
    n = points.distinct().groupBy("point").agg(F.count("*").alias("n"))
    known = points.distinct().join(paths, "state").groupBy("point", "path").agg(F.array_sort(F.collect_set(F.struct("state", "class"))).alias("at"), F.count("*").alias("in"), F.count("hit").alias("sure"), F.min("hit").alias("lo"), F.max("hit").alias("hi"))
    common = known.join(n, "point").filter(F.col("in") == F.col("n"))
    named = common.groupBy("point", "at").agg(F.min("path").alias("class"), F.collect_list(F.struct("path", F.when((F.col("sure") == F.col("n")) & (F.col("lo") == F.col("hi")), F.col("lo")).alias("hit"))).alias("p"))
    return named.select("point", "class", F.explode("p").alias("p")).select("point", "class", "p.path", "p.hit")


def unified(paths: DataFrame, equal: DataFrame) -> DataFrame:
    """(state, path, class, hit) after equal (state, a, b) paths are one class each, and so are their fields (congruence).

    A class with a sure hit is one: the greatest certainty of its members' classes counts.
    """
    node = lambda state, name: F.to_json(F.struct(F.col(state).alias("s"), F.col(name).alias("c")))
    state = written(paths)
    pairs = equal.select("state", "a", "b")
    while True:
        of = state.select("state", "path", "class")
        ends = pairs.join(of.select("state", F.col("path").alias("a"), F.col("class").alias("x")), ["state", "a"]).join(of.select("state", F.col("path").alias("b"), F.col("class").alias("y")), ["state", "b"]).filter("x <> y")
        base = of.filter("path like '%.%'").select("state", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1).alias("base"), F.substring_index("path", ".", -1).alias("field"), "class")
        held = base.join(of.select("state", F.col("path").alias("base"), F.col("class").alias("over")), ["state", "base"])
        first = held.groupBy("state", "over", "field").agg(F.min("class").alias("x"))
        congruent = held.join(first, ["state", "over", "field"]).select("state", "x", F.col("class").alias("y")).filter("x <> y")
        edges = written(ends.select("state", "x", "y").union(congruent).select(node("state", "x").alias("src"), node("state", "y").alias("dst")).distinct())
        if edges.isEmpty():
            sure = state.groupBy("state", "class").agg(F.max("hit").alias("hit"), F.min("path").alias("name"))
            return state.drop("hit").join(sure, ["state", "class"]).select("state", "path", F.col("name").alias("class"), "hit")
        named = graph.components(edges).select("node", F.get_json_object("component", "$.c").alias("to"))
        state = written(state.withColumn("node", node("state", "class")).join(named, "node", "left").select("state", "path", F.coalesce("to", "class").alias("class"), "hit"))


def forgotten(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths without those that begin with a forgotten root (state, root)."""
    return paths.withColumn("root", F.substring_index("path", ".", 1)).join(roots, ["state", "root"], "left_anti").drop("root")
