"""Tables cut from their lineage in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own folder only where that is unset in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="factweave-")
    return shared_dir.own


def stored(df: DataFrame) -> str:
    """The path of the frame as a written table."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The frame as a written table: later plans start from files that outlive executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def replaced(df: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    """The frame as a written table with its path; the table at the path ``old``, which nothing is read from any more, is deleted."""
    spark, path = df.sparkSession, stored(df)
    if old:
        where = spark._jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return spark.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to as many tasks as the session shuffles to, by a hash of keys: of rows that are little to read but much
    work, a file's few splits would leave all to a few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
