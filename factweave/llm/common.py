"""Shared pieces of the training-data operators: words, packed blobs, sizes and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import math
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of documents should hold; it bounds the memory of a task.
GROUP_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than ASCII white space; A-Z in lower case."""
    return text.lower().split()


def pack(value) -> bytes:
    """A compressed blob of numpy arrays or bytes, for a shuffle."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Only where it is unset in a local session, an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="factweave-")
    return shared_dir.own


def written(df: DataFrame) -> DataFrame:
    """The frame as a table written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_count(df: DataFrame, text: str = "text", least: int | None = None) -> int:
    """How many groups to deal the texts to: ``least`` or else the session's shuffle partitions at least.

    A group holds GROUP_BYTES; beyond 100 GB it grows with the root of the corpus (1 GB at 100 TB), as groups that send
    each other blobs would make more of these than there is to send.
    """
    total = df.select(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    size = max(GROUP_BYTES, math.sqrt(total * 1e4))
    return max(least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / size))


def tidy() -> None:
    """Give memory that a worker no longer uses back, as workers outlive their tasks and share a machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def slices(it: Iterator[pa.RecordBatch], text: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of so many bytes of text (the column with this number), but at least a row."""
    for batch in it:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)))
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def batches(columns: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
