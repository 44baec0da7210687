"""Cloning: which contexts of a function can share one copy of its code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def shared_code(contexts: DataFrame, invokes: DataFrame) -> DataFrame:
    """(ctx, code, group): the coarsest partition of contexts (ctx, code, facts) in which each group has one code and facts, and each of its operations calls the same groups.

    invokes (ctx, op, callee). All contexts of a code with equal facts begin in one group; groups are split by what their
    members' operations call, until a round splits none. A group is named by its least context.
    """
    start = contexts.select("ctx", "code", "facts").distinct()
    named = start.groupBy("code", "facts").agg(F.min("ctx").alias("group"))
    state = written(start.join(named, ["code", "facts"]).select("ctx", "code", "group"))
    calls = written(invokes.select("ctx", "op", "callee").distinct())
    groups = named.count()
    while True:
        to = calls.join(state.select(F.col("ctx").alias("callee"), F.col("group").alias("to")), "callee")
        sign = to.groupBy("ctx").agg(F.array_sort(F.collect_set(F.struct("op", "to"))).alias("sign"))
        signed = state.join(sign, "ctx", "left").withColumn("sign", F.coalesce("sign", F.array().cast(sign.schema["sign"].dataType)))
        parts = written(signed.groupBy("group", "sign").agg(F.min("ctx").alias("part")))
        now = parts.count()
        if now == groups:
            return state
        state, groups = written(signed.join(parts, ["group", "sign"]).select("ctx", "code", F.col("part").alias("group"))), now
