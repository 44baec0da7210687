"""Groups of rows that are equal: what is worked out for one of them holds for all.

Programs that repeat (vendored copies, generated code, orders of one pattern) are one class. A fixpoint over the first program of
each class has as many rows as there are different programs, and its result is given to all members by one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .fixpoint import FEW, brief, counted


def classes(rows: DataFrame, key: str, *content: str) -> tuple[DataFrame, DataFrame]:
    """(members, firsts): for each key the least one with equal rows (key, like), and the rows of these (key, *content).

    A key's rows count as often as they come, in any order; a null is no key. Classes are told apart by SHA-256 digests.
    """
    whole = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*content))).alias("same"))
    whole = written(whole.withColumn("digest", F.sha2(F.to_json("same", {"ignoreNullFields": "false"}), 256)))
    first = written(whole.groupBy("digest", "same").agg(F.min(key).alias("like")))
    named = brief(first.select("digest", "like"), first.count() <= FEW)
    members = written(whole.select(key, "digest").join(named, "digest").select(key, "like"))
    return members, first.select(F.col("like").alias(key), F.explode("same").alias("r")).select(key, "r.*")


def given(found: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, like, ...): what was found for the firsts (key, ...), for all members."""
    return members.join(counted(found.withColumnRenamed(key, "like"))[0], "like")
