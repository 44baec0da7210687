"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Windows of the benchmark items are hashed and broadcast in blocks of bounded size; each block is held against the token
windows of every document, hits are verified word by word, and hit words, spans or documents can be removed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, mix, table, written

#: Bytes of benchmark text in one broadcast block; larger benchmarks are worked through in several blocks.
BLOCK_BYTES = 16 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and turns each byte that is no part of a word into a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _hash(ids: np.ndarray, m: int) -> np.ndarray:
    h = np.zeros(len(ids) - m + 1, dtype=np.uint64)
    for j in range(m):
        h = mix(h * _MUL + ids[j : len(ids) - m + 1 + j].astype(np.uint64) + np.uint64(1))
    return h


class Index:
    """The windows of one block of items: by window length, sorted hashes and the exact windows behind each."""

    def __init__(self, items: list[tuple[object, bytes]], n: int = 10):
        self.ids: dict[bytes, int] = {}
        windows: dict[int, dict[int, dict[tuple, set]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item, text in items:
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in item_words(text)], dtype=np.int64)
            if len(w):
                m = min(n, len(w))
                for i, h in enumerate(_hash(w, m).tolist()):
                    windows[m][h][tuple(w[i : i + m].tolist())].add(str(item))
        self.windows = {m: {h: dict(x) for h, x in v.items()} for m, v in windows.items()}
        self.sorted = {m: np.array(sorted(v), dtype=np.uint64) for m, v in self.windows.items()}

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the occurrences as word ranges, and the items with an occurring window."""
        found = text.translate(FOLD).split()
        get = self.ids.get
        ids = np.array([get(x, 0) for x in found], dtype=np.int64)
        spans, items = [], set()
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        for m, table_ in self.windows.items():
            if len(ids) < m:
                continue
            at = np.flatnonzero(known[m:] == known[: len(known) - m])
            if not len(at):
                continue
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(m):
                h = mix(h * _MUL + ids[at + j].astype(np.uint64) + np.uint64(1))
            hay = self.sorted[m]
            k = np.minimum(np.searchsorted(hay, h), len(hay) - 1)
            for i in np.flatnonzero(hay[k] == h).tolist():
                s = int(at[i])
                if got := table_[int(h[i])].get(tuple(ids[s : s + m].tolist())):
                    spans.append((s, s + m))
                    items |= got
        return len(found), spans, items


def _union(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(bench: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size; a null text or id has no words or is the item ``None``."""
    block, held = [], 0
    for item, body in bench.select(F.col(item_id), F.col(text).cast("binary")).toLocalIterator(prefetchPartitions=False):
        body = bytes(body or b"")
        if block and held + len(body) > size:
            yield block
            block, held = [], 0
        block.append((item, body))
        held += len(body)
    yield block


def _merged(old: list | None, spans: list[tuple[int, int]]) -> list[int]:
    both = spans + (list(zip(old[::2], old[1::2], strict=True)) if old else [])
    return [x for s in _union(both) for x in s]


def _held_against(docs: DataFrame, bench: DataFrame, n: int, text: str, item_id: str, item_text: str, block_bytes: int, finish, schema: T.StructType) -> DataFrame:
    """``finish`` of each batch of documents with their word counts, hit word ranges and items, as rows of ``schema``.

    Each block of items is broadcast alone; between blocks the documents are written with what was found so far.
    """
    spark = docs.sparkSession
    columns = docs.schema.names
    types = T.StructType([*docs.schema.fields, *(T.StructField(f"_found_{k}", t) for k, t in enumerate((T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()))))])
    blocks = _blocks(bench, item_id, item_text, block_bytes)
    block, frame, first = next(blocks), docs, True
    while block is not None:
        following = next(blocks, None)
        held = spark.sparkContext.broadcast(block)  # at most block_bytes, or one item

        def run(it, held=held, first=first, last=following is None):
            index = Index(held.value, n)
            at = columns.index(text)
            for batch in it:
                bodies = batch.column(at).to_pylist()
                old = [[None] * len(bodies)] * 3 if first else [batch.column(len(columns) + k).to_pylist() for k in range(3)]
                counts, spans, items = [], [], []
                for body, s, i in zip(bodies, *old[1:], strict=True):
                    n_words, hits, found = index.hits(body if isinstance(body, bytes) else (body or "").encode())
                    counts.append(n_words)
                    spans.append(_merged(s, hits))
                    items.append(sorted({*(i or []), *found}))
                own = pa.RecordBatch.from_arrays(batch.columns[: len(columns)], schema=pa.schema(list(batch.schema)[: len(columns)]))
                if last:
                    yield from finish(own, counts, spans, items)
                else:
                    found = (pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())))
                    yield pa.RecordBatch.from_arrays([*own.columns, *found], names=[*columns, *(f"_found_{k}" for k in range(3))])

        frame = frame.mapInArrow(run, schema if following is None else types)
        if following is not None:
            frame = written(frame)
        block, first = following, False
    return frame


def scan(docs: DataFrame, bench: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (hit word ranges, end exclusive, merged), items (sorted item ids).

    A window is ``n`` consecutive words of an item, or the whole item if it has fewer. Null and empty texts have no
    words and no hits; an empty benchmark hits nothing; repeated rows each get their row. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    types = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def finish(batch, counts, spans, items):
        yield from batches({"doc_id": batch.column(0).to_pylist(), "n_words": counts, "spans": spans, "items": items}, schema)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return _held_against(picked, bench, n, "body", item_id, item_text, block_bytes, finish, types)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ends = F.filter("spans", lambda x, i: i % 2 == 1)
    starts = F.filter("spans", lambda x, i: i % 2 == 0)
    hit = F.aggregate(F.zip_with(ends, starts, lambda e, b: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, n: int = 10, mode: str = "documents", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without contamination, with all their columns.

    ``documents`` drops each document that holds a window of the benchmark; ``spans`` keeps them all and cuts the hit
    words, with what stands between two hit words, out of ``text``. Null texts stay, and so do all documents where the
    benchmark is empty. Repeated rows are treated alike.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")

    def finish(batch, counts, spans, items):
        if mode == "documents":
            yield batch.filter(pa.array([not s for s in spans], type=pa.bool_()))
        else:
            at = batch.schema.get_field_index("text")
            new = [t if not s else cut(t.encode(), list(zip(s[::2], s[1::2], strict=True))).decode() for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, type=batch.schema.field(at).type))

    return _held_against(docs, bench, n, "text", "item_id", "text", block_bytes, finish, docs.schema)


def cut(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word ranges."""
    flags = np.frombuffer(body.translate(FOLD), dtype=np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(body[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, body[at:]])
