"""A trie of the prefixes that conversations share, by distributed MSD radix partitioning over turn ids.

Turns are numbered by a dictionary of their digests, so that texts never move; equal conversations are one sequence with a
weight. A bucket holds the sequences with one prefix. In each round the rows of large buckets are dealt by their next turn:
children of at most ``local`` turns go to one task each, where multikey quicksort sorts them and its recursion emits their
nodes; larger ones skip what all their sequences share and go on to the next round. Sums over subtrees then go up, round
by round. The digest of a group of equal conversations is folded over sorted parts of its ids, whatever their number.

Defined results: a null role or text is empty; rows without a conv_id belong to no conversation and are left out; turns
with equal numbers are in order of their digests; repeated rows count each time; an empty table has no nodes; other columns
are not read. One conversation's turn numbers (8 bytes each) are one row, whatever its texts' length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidy, written

#: Turns that a bucket may hold to be finished by one task.
LOCAL = 1 << 16
#: Bytes of one part of a group's ids.
PART = 1 << 20

_NODE = "unit long, top boolean, top_depth int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long, end_n long"
_NODES = pa.schema([
    ("unit", pa.int64()), ("top", pa.bool_()), ("top_depth", pa.int32()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end", "end_n")),
])
_PART = pa.schema([("rep", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
_DIGEST = pa.schema([("end", pa.int64()), ("sha", pa.string())])


def encode(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words): each conversation's turn numbers in order, and the words of each turn's text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
    known = rows.groupBy("digest").agg(F.min("w").alias("w")).repartitionByRange("digest").sortWithinPartitions("digest")
    known = written(known.select("digest", "w", F.monotonically_increasing_id().alias("id")))
    named = rows.select("conv_id", "turn", "digest").join(known, "digest")
    listed = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "w"))).alias("t"))
    return listed.select("conv_id", F.col("t.id").alias("ids"), F.col("t.w").alias("words"))


def _sequences(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (rep, n, ids, words), and (end, sha) of the groups of several equal conversations."""
    seqs = written(convs.groupBy("ids").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.first("words").alias("words")).select("rep", "n", "ids", "words"))
    members = convs.select("conv_id", "ids").join(seqs.filter("n > 1").select("rep", "ids"), "ids").select("rep", "conv_id")
    parts = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_parts, "rep long, first long, ids binary")
    return seqs, parts.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_folded, "end long, sha string")


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids as comma-joined parts of bounded size."""
    group, first, ids, size = None, None, [], 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([first]), pa.array([b",".join(ids)])], schema=_PART)

    for batch in it:
        for rep, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (rep != group or size > PART):
                yield told()
                ids, size = [], 0
            if not ids:
                group, first = rep, conv
            ids.append(b"%d" % conv)
            size += len(ids[-1]) + 1
    if ids:
        yield told()


def _folded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest over the parts of each group, a part at a time."""
    group, sha = None, hashlib.sha256()
    out: list[tuple[int, str]] = []
    for batch in it:
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if rep != group:
                if group is not None:
                    out.append((group, sha.hexdigest()))
                group, sha = rep, hashlib.sha256(ids)
            else:
                sha.update(b"," + ids)
    if group is not None:
        out.append((group, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=f.type) for k, f in enumerate(_DIGEST)], schema=_DIGEST)


class Bucket:
    """Multikey quicksort of the sequences of some units; its recursion emits nodes."""

    def __init__(self, start: np.ndarray, size: np.ndarray, ids: np.ndarray, words: np.ndarray, rep: np.ndarray, n: np.ndarray):
        self.start, self.size, self.ids, self.words, self.rep, self.n = start, size, ids, words, rep, n
        self.order = np.arange(len(rep))
        self.up: list[int] = []  # the node above
        self.depth: list[int] = []
        self.conv: list[int] = []
        self.weight: list[int] = []
        self.said: list[int] = []
        self.ends: dict[int, int] = {}
        self.alone: list[tuple[int, int, int]] = []

    def sort(self, lo: int, hi: int) -> None:
        todo = [(lo, hi, 0, -1)]
        while todo:
            lo, hi, d, above = todo.pop()
            rows = self.order[lo:hi]
            if hi - lo == 1:
                self.alone.append((int(rows[0]), d, above))
                continue
            ended = self.size[rows] <= d
            if ended.any():  # sequences are distinct, so one at most
                self.ends[above] = int(rows[ended][0])
                rows = np.concatenate((rows[ended], rows[~ended]))
                self.order[lo:hi] = rows
                todo.append((lo + 1, hi, d, above))
                continue
            keys = self.ids[self.start[rows] + d]
            a, b, c = keys[0], keys[len(keys) // 2], keys[-1]
            pivot = max(min(a, b), min(max(a, b), c))
            less, more = keys < pivot, keys > pivot
            same = rows[~(less | more)]
            self.order[lo:hi] = np.concatenate((rows[less], same, rows[more]))
            left = lo + int(np.count_nonzero(less))
            right = left + len(same)
            if right < hi:
                todo.append((right, hi, d, above))
            if lo < left:
                todo.append((lo, left, d, above))
            self.up.append(above)
            self.depth.append(d + 1)
            self.conv.append(int(self.rep[same].min()))
            self.weight.append(int(self.n[same].sum()))
            self.said.append(int(self.words[self.start[same[0]] + d]))
            todo.append((left, right, d + 1, len(self.up) - 1))

    def nodes(self) -> dict[str, np.ndarray]:
        """Columns of all nodes; parents are indices here, -1 at the top of a unit. ``unit`` is a row of it."""
        row, d, above = (np.array([x[k] for x in self.alone], np.int64) for k in range(3))
        left = self.size[row] - d
        for r, x in zip(row[left == 0].tolist(), above[left == 0].tolist(), strict=True):
            self.ends[x] = r
        row, d, above, left = (x[left > 0] for x in (row, d, above, left))
        old = len(self.up)
        total = int(left.sum())
        begin = np.cumsum(left) - left
        step = np.arange(total) - np.repeat(begin, left)
        chain = np.repeat(row, left)
        up = np.where(step == 0, np.repeat(above, left), old + np.arange(total) - 1)
        depth = np.repeat(d, left) + step + 1
        out = {
            "up": np.concatenate((np.array(self.up, np.int64), up)), "depth": np.concatenate((np.array(self.depth, np.int64), depth)),
            "conv": np.concatenate((np.array(self.conv, np.int64), self.rep[chain])), "n": np.concatenate((np.array(self.weight, np.int64), self.n[chain])),
        }
        said = np.concatenate((np.array(self.said, np.int64), self.words[self.start[chain] + depth - 1]))
        end = np.full(old + total, -1)
        for x, r in self.ends.items():
            end[x] = r
        end[old + begin + left - 1] = row
        children = np.bincount(out["up"][out["up"] >= 0], minlength=old + total)
        leaves, saved = (children == 0).astype(np.int64), (out["n"] - 1) * said
        by_depth = np.argsort(-out["depth"], kind="stable")
        bounds = np.flatnonzero(np.diff(out["depth"][by_depth], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x = by_depth[a:b]
            x = x[out["up"][x] >= 0]
            np.add.at(leaves, out["up"][x], leaves[x])
            np.add.at(saved, out["up"][x], saved[x])
        return out | {"end": end, "children": children, "leaves": leaves, "saved": saved}


def _finished(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of local units: rows (unit, bucket, depth, rep, n, ids, words) come sorted by unit; ids begin after the bucket's depth."""
    held: list[pa.RecordBatch] = []
    turns = 0
    for batch in it:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy()
        size = np.asarray(batch.column(5).value_lengths())
        begin = 0
        for at in np.append(np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)).tolist():
            if turns > LOCAL and (held and (begin or held[-1].column(0)[-1].as_py() != int(unit[0]))):
                yield _of_units(held)
                held, turns = [], 0
            held.append(batch.slice(begin, at - begin))
            turns += int(size[begin:at].sum())
            begin = at
    if held:
        yield _of_units(held)
    tidy()


def _of_units(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    col = lambda k: rows.column(k).chunk(0)
    unit, bucket, above, rep, n = (col(k).to_numpy() for k in range(5))
    size = np.asarray(col(5).value_lengths()).astype(np.int64)
    b = Bucket(np.cumsum(size) - size, size, np.asarray(col(5).flatten()), np.asarray(col(6).flatten()).astype(np.int64), rep, n)
    bounds = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)])).tolist()
    of = []  # a row of the unit of each node
    alone = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        b.sort(lo, hi)
        of += [lo] * (len(b.up) - len(of))
        alone += [lo] * (len(b.alone) - len(alone))
    left = [int(b.size[r]) - d for r, d, _ in b.alone]
    x = b.nodes()
    of = np.concatenate((np.array(of, np.int64), np.repeat(np.array(alone, np.int64), left)))
    top = x["up"] < 0
    parent = np.where(top, bucket[of], x["conv"][x["up"]])
    has = x["end"] >= 0
    cols = [
        pa.array(unit[of]), pa.array(top), pa.array(above[of].astype(np.int32)), pa.array(x["conv"]), pa.array(x["depth"] + above[of]), pa.array(parent), pa.array(x["n"]), pa.array(x["children"]),
        pa.array(x["leaves"]), pa.array(x["saved"]), pa.array(rep[x["end"]], mask=~has), pa.array(n[x["end"]], mask=~has),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _NODES, strict=True)], schema=_NODES)


def _shared(lo: str, hi: str, least: str) -> Column:
    """How many first items two arrays share, at least ``least``."""
    differs = F.expr(f"array_position(transform(sequence(1, least(size({lo}), size({hi}))), i -> {lo}[i - 1] = {hi}[i - 1]), false)")
    return F.greatest(F.expr(least), F.when(differs > 0, differs - 1).otherwise(F.least(F.size(lo), F.size(hi)))).cast("int")


def nodes(convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of (conv_id, ids, words): a row for each node, as the contract of ``op11`` has them.

    A node is told by its depth and its smallest member.
    """
    seqs, digests = _sequences(convs)
    digests = written(digests)
    root = written(seqs.groupBy().agg(F.min("rep").alias("bucket"), F.sum("n").cast("long").alias("n")).filter("bucket is not null").select("bucket", F.lit(0).alias("depth"), F.lit(-1).alias("above"), F.lit(None).cast("long").alias("parent"), "n", F.array(F.lit(0)).alias("said")))
    first = root.first()
    if first is None:
        return seqs.filter("false").select(*(F.col("rep").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
    rows = seqs.select(F.lit(first["bucket"]).alias("bucket"), F.lit(0).alias("depth"), "rep", "n", "ids", "words")
    large, done, ended = [root], [], []
    while True:
        ended.append(rows.filter("size(ids) = depth").select("bucket", "depth", F.col("rep").alias("end"), F.col("n").alias("end_n")))
        live = rows.filter("size(ids) > depth").withColumn("id", F.expr("ids[depth]"))
        kids = live.groupBy("bucket", "id").agg(F.min("rep").alias("unit"), F.sum("n").alias("members"), F.sum(F.expr("size(ids) - depth")).alias("turns"))
        dealt = written(live.join(kids, ["bucket", "id"]).withColumn("large", F.col("turns") > local))
        small = dealt.filter("not large").select("unit", "bucket", "depth", "rep", "n", F.expr("slice(ids, depth + 1, size(ids))").alias("ids"), F.expr("slice(words, depth + 1, size(words))").alias("words"))
        done.append(written(small.repartition("unit").sortWithinPartitions("unit").mapInArrow(_finished, _NODE)))
        big = dealt.filter("large")
        spans = big.groupBy("unit", "bucket", "depth", "members").agg(F.min(F.struct("ids", "words")).alias("lo"), F.max("ids").alias("hi")).withColumn("lo_ids", F.col("lo.ids"))
        spans = spans.withColumn("upto", _shared("lo_ids", "hi", "depth + 1"))
        spans = written(spans.select(F.col("unit").alias("bucket"), F.col("upto").alias("depth"), F.col("depth").alias("above"), F.col("bucket").alias("parent"), F.col("members").alias("n"), F.expr("slice(lo.words, depth + 1, upto - depth)").alias("said")))
        if spans.isEmpty():
            break
        large.append(spans)
        rows = written(big.select(F.col("unit").alias("bucket"), "rep", "n", "ids", "words").join(spans.select("bucket", "depth"), "bucket").select("bucket", "depth", "rep", "n", "ids", "words"))
    return _told(_summed(large, done, ended), digests)


def _summed(large: list[DataFrame], done: list[DataFrame], ended: list[DataFrame]) -> DataFrame:
    """All nodes; the sums of large buckets' nodes are made from the last round to the first."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end", "end_n"]
    out, above = None, None
    for buckets, small, ends in reversed(list(zip(large, done, ended, strict=True))):
        tops = small.filter("top").select(F.col("parent_conv_id").alias("bucket"), "n_leaves", "saved_tokens")
        below = (tops if above is None else tops.unionByName(above)).groupBy("bucket").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        said = buckets.join(below, "bucket", "left").join(ends.select("bucket", "end", "end_n"), "bucket", "left")
        steps = said.select("*", F.posexplode("said").alias("k", "w"))
        last = F.expr("k = size(said) - 1")
        down = Window.partitionBy("bucket").orderBy(F.desc("k"))
        mine = written(steps.select(
            F.col("bucket").alias("conv_id"), (F.col("above") + F.col("k") + 1).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.coalesce("kids", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) + (F.col("n") - 1) * F.sum("w").over(down)).cast("long").alias("saved_tokens"), F.when(last, F.col("end")).alias("end"), F.when(last, F.col("end_n")).alias("end_n"), (F.col("k") == 0).alias("top"),
        ))
        above = mine.filter("top").select(F.col("parent_conv_id").alias("bucket"), "n_leaves", "saved_tokens")
        both = mine.select(columns).unionByName(small.select(columns))
        out = both if out is None else out.unionByName(both)
    return out


def _told(found: DataFrame, digests: DataFrame) -> DataFrame:
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256)
    one = found.filter("end is null or end_n = 1").withColumn("ends_sha256", own)
    some = found.filter("end_n > 1").join(digests, "end").withColumnRenamed("sha", "ends_sha256")
    return one.select(columns).unionByName(some.select(columns))


def rebuilt(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that begin with up to ``heads`` - 1 turns of the one whose id is the next multiple of ``every`` towards 0."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = convs.withColumn("h", h.cast("int")).withColumn("root", F.col("conv_id") - F.col("conv_id") % every)
    first = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("root"), F.expr(f"slice(ids, 1, {heads - 1})").alias("head"), F.expr(f"slice(words, 1, {heads - 1})").alias("head_words"))
    mixed = lambda head, c: F.expr(f"concat(coalesce(slice({head}, 1, h), slice({c}, 1, 0)), slice({c}, h + 1, size({c})))").alias(c)
    return own.join(first, "root", "left").select("conv_id", mixed("head", "ids"), mixed("head_words", "words"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(written(rebuilt(written(encode(table(spark, sf_dir, "conversations"))))))
