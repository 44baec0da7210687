"""Sharding by sampled splitters.

Size-weighted key samples give quantile splitters, the splitters cut the key space into many small ranges, overfull
ranges are sampled and cut again, and exact running byte counts over the ranges place every record. The law is
``bytes``: shard sizes are near equal. Equal texts have equal leading key parts, so a group of copies stays in one
range, and in one shard, unless it alone overfills a range; then it is cut by document.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Low bits of a range key that tell the documents of one group apart.
DOC_BITS = 31


def _range_of(splitters: list[int]):
    cuts = np.array(splitters, dtype=np.int64)

    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    return of


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", ranges_per_shard: int = 64, samples_per_range: int = 4) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Null texts count as empty (size 8, CRC 0) and a
    null doc_id is a key of its own; equal rows are placed one after the other. An empty table gives no rows. Other
    columns of ``docs`` are not read. The driver sees at most about
    ``shards * ranges_per_shard * (samples_per_range + 1)`` keys, whatever the input's size.
    """
    body = F.col(text).cast("binary")
    crc = F.coalesce(F.crc32(body), F.lit(0)).cast("long")
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        (F.shiftleft(crc, DOC_BITS) + F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 64 - DOC_BITS)).alias("_key"),
    )
    count, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = max(1, shards * ranges_per_shard)
    unit = max(1.0, total / (wanted * samples_per_range))

    def sample(rows: DataFrame, step: float, seed: int) -> list[int]:
        u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.lit(seed)), 12) / F.lit(float(1 << 52))
        return sorted(r[0] for r in rows.filter(u < F.col("size") / F.lit(step)).select("_key").collect())

    first = sample(base, unit, 1)
    picked = first[samples_per_range::samples_per_range]
    splitters = sorted({k >> DOC_BITS << DOC_BITS for k in picked})  # at the start of a group of equal texts
    for turn in range(4):
        ranged = base.withColumn("_range", _range_of(splitters)("_key"))
        stats = {r[0]: (r[1], r[2]) for r in ranged.groupBy("_range").agg(F.sum("size"), F.count("*")).collect()}
        if turn == 3:
            break
        full = [k for k, (b, n) in stats.items() if b > 4 * total / wanted and n > 1]
        if not full:
            break
        more = sample(ranged.filter(F.col("_range").isin(full)), unit, 2 + turn)
        old = set(splitters)
        for k in full:
            lo = splitters[k - 1] if k else -1
            hi = splitters[k] if k < len(splitters) else 1 << 62
            inside = more[bisect.bisect_right(more, lo) : bisect.bisect_left(more, hi)][samples_per_range // 2 :: samples_per_range]
            groups = {x >> DOC_BITS << DOC_BITS for x in inside} - old
            old |= {x for x in groups if x > lo} or set(inside)
        if len(old) == len(splitters):
            break
        splitters = sorted(old)
    starts, bytes_before, rows_before = [], 0, 0
    for k in range(len(splitters) + 1):
        b, n = stats.get(k, (0, 0))
        starts.append((bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + b, rows_before + n
    byte_start, row_start = (np.array([s[i] for s in starts], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("long")
    def bytes_to(r: pd.Series) -> pd.Series:
        return pd.Series(byte_start[r.to_numpy()])

    @F.pandas_udf("long")
    def rows_to(r: pd.Series) -> pd.Series:
        return pd.Series(row_start[r.to_numpy()])

    order = Window.partitionBy("_range").orderBy("_key", "doc_id", "text_crc32", "size")
    group = Window.partitionBy("_range", "text_crc32")
    placed = (
        base.withColumn("_range", _range_of(splitters)("_key"))
        .withColumns({"_b": bytes_to("_range"), "_r": rows_to("_range")})
        .withColumns({"_to": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_row": F.col("_r") + F.row_number().over(order) - 1})
        .withColumns({"_lo": F.min(F.col("_to") - F.col("size")).over(group), "_hi": F.max("_to").over(group)})
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((2 * F.col("_b") + F.col("_lo") + F.col("_hi")) / F.lit(2.0) * shards / F.lit(float(max(total, 1))))).cast("int"))
    )
    first_row = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first_row), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), 24)
