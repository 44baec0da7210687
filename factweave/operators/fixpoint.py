"""The fixpoint kernel: semi-naive iteration with lineage cut after each round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored, written

#: Rows that joins broadcast, so that a round with little new shuffles nothing that is large.
FEW = 100_000


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, int, bool]:
    """All rows that ``step(delta, all)`` derives from ``seed``: (rows, rounds, converged).

    Each round joins only the rows that the last one added; all rows so far are one scan of the rounds' files,
    and are shuffled only in rounds that find much.
    ``keys`` say when two rows are the same; rows keep the types of ``seed``. ``limit`` stops a run that has not converged;
    without it the loop ends when nothing is new. An empty seed gives an empty result.
    """
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in seed.schema]
    keys, read = keys or seed.columns, seed.sparkSession.read.schema(seed.schema).parquet
    parts, rounds = [[stored(seed.dropDuplicates(keys))]], 0  # paths, by how often their rows have been written again
    every = delta = read(parts[0][0])
    fresh = bool(delta.take(1))
    while fresh:
        if limit is not None and rounds >= limit:
            return every, rounds, False
        rounds += 1
        found, few = counted(step(delta, every).select(typed).dropDuplicates(keys))
        known = every.select(keys)
        if few:  # of all rows only those that were found again, so that they need no shuffle
            known = known.join(found.select(keys), keys, "left_semi")
        new = stored(found.join(known, keys, "left_anti"))
        _add(parts, 0, new, read)
        delta, every = brief(read(new), few), read(*(p for level in parts for p in level))
        fresh = bool(delta.take(1))
    return every, rounds, True


def counted(df: DataFrame) -> tuple[DataFrame, bool]:
    """The frame as a written table, broadcast to joins where it has few rows, and whether it has."""
    table = written(df)
    few = table.count() <= FEW
    return brief(table, few), few


def brief(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _add(parts: list[list[str]], level: int, new: str, read: Callable[..., DataFrame]) -> None:
    """Keep a part. Eight of one level become one of the next, so that over r rounds each row is written again log8(r) times at most."""
    if level == len(parts):
        parts.append([])
    parts[level].append(new)
    if len(parts[level]) > 8:
        whole = stored(read(*parts[level]))
        parts[level] = []
        _add(parts, level + 1, whole, read)
