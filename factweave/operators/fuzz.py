"""Byte mutations of inputs, as a generator of test data, and names for what is kept."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values at the edges of integer types (fixed values).
EDGES = (0, 1, 16, 32, 64, 100, 127, 128, 255)


def mutate(body: bytes, seed: int, most: int = 4096) -> bytes:
    """One mutation, chosen by the seed: remove, insert, copy or swap stretches; flip, set, add to or replace bytes."""
    rng = random.Random(seed)
    b = bytearray(body)
    kind = rng.randrange(8)
    at = rng.randrange(len(b) + 1)
    n = rng.randrange(1, 9)
    if kind == 0:
        del b[at : at + n]
    elif kind == 1 or not b:
        b[at:at] = bytes(rng.randrange(256) for _ in range(n))
    elif kind == 2:
        b[at:at] = b[rng.randrange(len(b)) :][:n]
    else:
        at = min(at, len(b) - 1)
        other = rng.randrange(len(b))
        if kind == 3:
            b[at] ^= 1 << rng.randrange(8)
        elif kind == 4:
            b[at] = rng.choice(EDGES)
        elif kind == 5:
            b[at] = (b[at] + rng.choice((-n, n))) % 256
        elif kind == 6:
            b[at], b[other] = b[other], b[at]
        else:
            b[at] = rng.randrange(256)
    return bytes(b[:most])


def mutations(inputs: DataFrame, rounds: int = 1) -> DataFrame:
    """(id, round, body, name) of inputs (id, body): names are hashes of the bytes."""

    @F.pandas_udf("binary")
    def changed(body: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([mutate(bytes(b or b""), int(s)) for b, s in zip(body, seed, strict=True)])

    many = inputs.select("id", "body", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    new = many.select("id", "round", changed("body", F.xxhash64("id", "round")).alias("body"))
    return new.withColumn("name", F.sha2("body", 256))


def only_new(rows: DataFrame, there: DataFrame) -> DataFrame:
    """Rows whose content hash (name) is not there yet: writing them twice writes nothing new."""
    return rows.dropDuplicates(["name"]).join(there.select("name"), "name", "left_anti")
