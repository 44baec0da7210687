"""Document fingerprints by winnowing, in column functions only.

Every k bytes of a text's UTF-8 form have a hash; of each window of w hashes the least is chosen, the rightmost of equal ones,
and chosen hashes are kept with their positions. Any stretch of k + w - 1 bytes that two texts share has a chosen hash in
both. The hash is the cyclic code CRC-32, a polynomial one that the JVM computes for each k-gram at a few bytes a cycle, as a
column function has no state to roll. Texts are read in chunks of windows, so that what is held at a time has a bound;
a changed text takes over the chunks in front of the change.

Which document follows which is found without a sort in one place: ranges of ids are dealt out, and the first row of each
range is also sent to the range before, the very first to the last.

Defined results: a null text is empty and has no hashes; texts of fewer than k bytes have one hash, and fewer than w hashes
are one window; two fingerprints without hashes are alike (1). Rows with equal ids, null ids last, are in order of a hash of
their texts and then of these, repeated rows next to each other; a lone document follows itself; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_count, table

#: Bytes of a gram, grams of a window, windows of a chunk.
GRAM, WINDOW, CHUNK = 16, 32, 512
_LOW = (1 << 31) - 1


def _chosen(chunk: str) -> str:
    """Positions and hashes chosen in a chunk: an array of hash * 2**31 - position, whose least is the rightmost of the least.

    The fold holds the hash chosen last (c), the first window end that it is not in (e), and all chosen ones (o).
    """
    grams = f"transform(sequence(1L, greatest(1L, octet_length({chunk}) - {GRAM - 1}L)), i -> shiftleft(crc32(substring({chunk}, cast(i as int), {GRAM})), 31) - i)"
    took = lambda v: f"transform(array({v}), m -> named_struct('c', m, 'e', cast((-m) & {_LOW}L as int) + {WINDOW}, 'o', concat(s.o, array(m))))[0]"
    again = took(f"array_min(slice(g, greatest(i - {WINDOW - 1}, 1), {WINDOW}))")
    begin = "named_struct('c', cast(null as bigint), 'e', 0, 'o', cast(array() as array<bigint>))"
    return f"transform(array({grams}), g -> aggregate(sequence(least({WINDOW}, size(g)), size(g), 1), {begin}, (s, i) -> if(i >= s.e, {again}, if(g[i - 1] < s.c, {took('g[i - 1]')}, s)), s -> s.o))[0]"


def chunks(text: str, begin: str = "0") -> Column:
    """For each chunk of a text column, from a byte on that is a multiple of CHUNK: its prints as hash * 2**31 + position."""
    last = f"greatest(octet_length(t) - {GRAM + WINDOW - 1}, 0)"
    prints = f"transform({_chosen('c')}, m -> ((m + {_LOW}L) & ~{_LOW}L) + ((-m) & {_LOW}L) + j)"
    one = f"transform(array(substring(t, j + 1, {CHUNK + GRAM + WINDOW - 2})), c -> {prints})[0]"
    begins = f"if(octet_length(t) = 0 or {begin} > {last}, cast(array() as array<int>), sequence({begin}, greatest({last}, {begin}), {CHUNK}))"
    return F.expr(f"transform(array(cast({text} as binary)), t -> transform({begins}, j -> {one}))[0]")


def prints(parts: str) -> Column:
    """All prints of a text's chunks; one that two chunks have chosen comes once."""
    return F.expr(f"array_distinct(flatten({parts}))")


def hashes(found: str | Column) -> Column:
    return F.array_distinct(F.transform(found, lambda v: F.shiftright(v, 31)))


def told(found: str) -> Column:
    """A fingerprint as text: hexadecimal hashes with their positions, from 1 on."""
    return F.array_join(F.transform(found, lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 31))), F.lit("@"), v.bitwiseAND(_LOW).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """The Jaccard similarity of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their prints (array of bigint) and fingerprint (string), which replace columns of these names."""
    found = docs.withColumn("prints", chunks(f"coalesce({text}, '')")).withColumn("prints", prints("prints"))
    return found.withColumn("fingerprint", told("prints"))


def _ranges(docs: DataFrame, parts: int) -> tuple[list[tuple], list[tuple]]:
    """The least and the greatest key of each range of rows, in descending order: a row for each range to the driver."""
    placed = docs.select("key").repartitionByRange(parts, F.desc("key")).select("key", F.spark_partition_id().alias("p"))
    found = sorted(((tuple(r["lo"]), tuple(r["hi"])) for r in placed.groupBy("p").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()), reverse=True)
    return [lo for lo, _ in found], [hi for _, hi in found]


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def followed(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, next_text, parts, marks, next_marks): each document with the next one of descending id, after the last the first."""
    key = F.struct(F.col("doc_id").isNotNull().cast("int").alias("a"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("b"), F.xxhash64("text").alias("c"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key)
    lows, highs = _ranges(rows, 4 * parts)
    if not lows:
        lows = highs = [(0, 0, 0)]
    width = math.isqrt(len(lows)) + 1
    kind = "struct<a: int, b: bigint, c: bigint>"
    as_rows = lambda keys: [dict(zip("abc", k, strict=True)) for k in keys]
    groups = [as_rows(lows[k : k + width]) for k in range(0, len(lows), width)]
    above = lambda keys: F.size(F.filter(keys, lambda x: x > F.col("key")))
    in_group = above(F.get(_literal(groups, f"array<array<{kind}>>"), F.col("g") - 1))
    placed = rows.withColumn("g", above(_literal([g[0] for g in groups], f"array<{kind}>"))).withColumn("at", F.when(F.col("g") == 0, 0).otherwise((F.col("g") - 1) * width + in_group))
    is_first = F.get(_literal(as_rows(highs), f"array<{kind}>"), F.col("at")) == F.col("key")
    before = F.when(F.col("at") == 0, len(lows) - 1).otherwise(F.col("at") - 1)
    place = lambda at, ghost: F.struct(at.cast("int").alias("at"), F.lit(ghost).alias("ghost"))
    sent = placed.withColumn("to", F.explode(F.when(is_first, F.array(place(F.col("at"), 0), place(before, 1))).otherwise(F.array(place(F.col("at"), 0)))))
    dealt = sent.select("doc_id", "text", F.col("key.c").alias("tie"), "to.at", "to.ghost").repartition(parts, "at")
    marked = dealt.withColumn("parts", chunks("text")).withColumn("marks", hashes(F.flatten("parts")))
    order = Window.partitionBy("at").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("tie"), F.desc("text"))
    return marked.select("*", F.lead("text").over(order).alias("next_text"), F.lead("marks").over(order).alias("next_marks")).filter("ghost = 0").select("doc_id", "text", "next_text", "parts", "marks", "next_marks")


def edited(docs: DataFrame) -> DataFrame:
    """The contract's rows: fingerprints of texts and of texts whose last third the next document's beginning replaces."""
    rows = followed(docs, group_count(docs)).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("head", F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"))
    rows = rows.withColumn("edited", F.concat("head", F.expr("substring(next_text, 1, cast(n_chars div 3 as int))")))
    rows = rows.withColumn("same", F.expr(f"greatest((octet_length(head) - {GRAM + WINDOW - 2}) div {CHUNK}, 0)").cast("int")).drop("head", "next_text")
    rows = rows.withColumn("new_parts", F.concat(F.expr("slice(parts, 1, same)"), chunks("edited", f"same * {CHUNK}"))).withColumn("prints", prints("parts")).withColumn("new_prints", prints("new_parts"))
    rows = rows.withColumn("new_marks", hashes("new_prints"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), told("prints").alias("fingerprint"), told("new_prints").alias("edited_fingerprint"),
        likeness("marks", "new_marks").alias("near_edited"), likeness("marks", "next_marks").alias("near_next"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
