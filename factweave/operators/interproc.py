"""Analyses between functions: growth of the call graph from its roots, and summaries of functions from the bottom up.

Facts of functions (slots have names of their own over all functions):
flows (fn, src, dst); refs (fn, slot, target) for slots that hold a function; calls (fn, site, slot) through a slot;
actuals (site, pos, slot) and formals (fn, pos, slot), where position -1 is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .fixpoint import brief, counted, fixpoint

RESULT = -1


def _listed(asked: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the positions and slots of each asked call site or function."""
    listed = facts.select(key, F.struct("pos", "slot").alias("f")).groupBy(key).agg(F.collect_set("f").alias(name))
    return written(asked.select(key).distinct().join(listed, key, "left"))


def top_down(flows: DataFrame, refs: DataFrame, calls: DataFrame, actuals: DataFrame, formals: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, edges): the functions that slots hold (slot, target), and the calls (fn, site, target) of functions that the roots (fn) reach.

    One fixpoint over rows (kind, a, b, c): ``H`` slot a holds function b, ``C`` what a holds is copied to b, ``K`` function b
    calls at site c what a holds, ``E`` function a calls at site b function c, ``L`` function a is reached. New functions meet all
    uses of their slot and new uses all functions of theirs, both by equality of the slot; calls bring their copies in the same round,
    and what a reached function does is a row for each of its facts in the next.
    """
    row = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), *(p.alias(c) for p, c in zip([*parts, *[F.lit("")] * (3 - len(parts))], "abc", strict=True)))
    col = F.col
    does = flows.select("fn", row("C", col("src"), col("dst")).alias("r")).unionByName(refs.select("fn", row("H", col("slot"), col("target")).alias("r"))).unionByName(calls.select("fn", row("K", col("slot"), col("fn"), col("site")).alias("r")))
    does, given, own = written(does.distinct()), _listed(calls, actuals, "site", "given"), _listed(refs, formals.withColumnRenamed("fn", "target"), "target", "own")
    copies = F.expr(f"""flatten(transform(coalesce(given, array()), g -> transform(filter(coalesce(own, array()), o -> o.pos = g.pos), o ->
      named_struct('kind', 'C', 'a', if(g.pos = {RESULT}, o.slot, g.slot), 'b', if(g.pos = {RESULT}, g.slot, o.slot), 'c', ''))))""")
    held = lambda f: f.filter("kind = 'H'").select("a", col("b").alias("target"))
    used = lambda f: f.filter("kind in ('C', 'K')").select("a", "kind", "b", "c")

    def step(delta: DataFrame, every: DataFrame) -> DataFrame:
        met, few = counted(held(delta).join(used(every), "a").unionByName(held(every).join(used(delta), "a")))
        moved = met.filter("kind = 'C'").select(row("H", col("b"), col("target")).alias("r"))
        found = met.filter("kind = 'K'").select(col("b").alias("fn"), col("c").alias("site"), "target")
        found = brief(found.join(given, "site"), few).join(own, "target")
        brought = found.select(F.explode(F.concat(F.array(row("E", col("fn"), col("site"), col("target")), row("L", col("target"))), copies)).alias("r"))
        done = delta.filter("kind = 'L'").select(col("a").alias("fn")).join(does, "fn").select("r")
        return moved.unionByName(brought).unionByName(done).select("r.*")

    every = fixpoint(roots.select(row("L", col("fn")).alias("r")).select("r.*"), step)[0]
    return every.filter("kind = 'H'").select(col("a").alias("slot"), col("b").alias("target")), every.filter("kind = 'E'").select(col("a").alias("fn"), col("b").alias("site"), col("c").alias("target"))


def summaries(flows: DataFrame, calls: DataFrame, actuals: DataFrame, formals: DataFrame) -> DataFrame:
    """(fn, i, o): the values of formal i may come out at formal o; calls (fn, site, target) are known.

    From the bottom up in one fixpoint over rows (kind, fn, a, b): ``R`` formal a reaches slot b, ``C`` slot a is copied to slot b.
    Functions that call nothing have their summaries first; each round's new summaries become copies between the slots that
    call sites give, so that their callers, of the same strong component or above it, go on in the next round.
    """
    own = written(formals.select("fn", "pos", "slot").distinct())
    sites = written(calls.select("fn", "site", "target").distinct().join(_listed(calls, actuals, "site", "given"), "site").select("fn", "target", "given"))

    def rows(reached: DataFrame, few: bool = False) -> DataFrame:
        """The rows of (fn, i, slot), with the copies that their summaries make at call sites."""
        came = reached.join(own.select("fn", "slot", F.col("pos").alias("o")), ["fn", "slot"]).filter("i <> o").select(F.col("fn").alias("target"), "i", "o").distinct()
        ends = F.expr("flatten(transform(filter(given, g -> g.pos = i), g -> transform(filter(given, h -> h.pos = o), h -> named_struct('a', g.slot, 'b', h.slot))))")
        made = brief(came, few).join(sites, "target").select("fn", F.explode(ends).alias("c")).select(F.lit("C").alias("kind"), "fn", "c.*")
        return reached.select(F.lit("R").alias("kind"), "fn", F.col("i").cast("string").alias("a"), F.col("slot").alias("b")).unionByName(made)

    def step(delta: DataFrame, every: DataFrame) -> DataFrame:
        reached = lambda f: f.filter("kind = 'R'").select("fn", F.col("a").cast("int").alias("i"), F.col("b").alias("src"))
        copied = lambda f: f.filter("kind = 'C'").select("fn", F.col("a").alias("src"), F.col("b").alias("slot"))
        went = reached(delta).join(copied(every), ["fn", "src"]).unionByName(reached(every).join(copied(delta), ["fn", "src"]))
        return rows(*counted(went.select("fn", "i", "slot").distinct()))

    seed = rows(own.select("fn", F.col("pos").alias("i"), "slot")).unionByName(flows.select(F.lit("C").alias("kind"), "fn", F.col("src").alias("a"), F.col("dst").alias("b")))
    found = fixpoint(seed, step)[0].filter("kind = 'R'").select("fn", F.col("a").cast("int").alias("i"), F.col("b").alias("slot"))
    return found.join(own.select("fn", "slot", F.col("pos").alias("o")), ["fn", "slot"]).filter("i <> o").select("fn", "i", "o").distinct()
