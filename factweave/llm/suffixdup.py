"""Removal of repeated byte strings with a suffix array made by bucket-pointer refinement.

A text's windows (all strings of the given length) are grouped by an anchor: the least of a window's hashed 16-grams. Equal
windows have equal anchors at equal places, so they share a stretch of text around the anchor, the core. Cores that occur
once in the whole corpus hold no repeats; the windows of all others meet at one task for each part of the core hashes.
There identical surroundings are joined first, and the suffixes of what is left are sorted: q-gram buckets, refined by
sorting on the bucket pointers of later offsets, each refinement using the pointers that the ones before have updated.
Windows in one bucket at full depth are equal; all but the earliest are repeats.

Windows of very common cores do not meet at one task: each document group joins its own equal windows first, letter by
letter, and the distinct ones that are left meet those of other groups by hashes of whole windows, in the same suffix arrays.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, group_count, mix, pack, rows_of, table, tidy, unpack

#: Letters of an anchor.
GRAM = 16
#: The windows of cores with more places than this are dealt singly, so that they do not meet at one task.
COMMON = 10_000
#: Letters of the q-grams that make the first buckets, and suffixes that are refined at once, but at least a bucket.
GRAMS, CHUNK = 32, 1 << 16
#: Bytes of text in one block of the anchor search.
BLOCK = 1 << 19
#: Bytes that one suffix array holds, but at least the places of a core.
SORTED = 1 << 20
#: Stands for a null doc_id, before all others.
NONE = -(1 << 63)

_rng = np.random.default_rng(20)
_LETTER = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    got = _power.get(which)
    if got is None or len(got[0]) < n:
        size = max(n, BLOCK * 2)
        base = int(_BASE[which])
        inverse = pow(base, -1, 1 << 64)
        got = _power[which] = tuple(np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, dtype=np.uint64)))) for b in (base, inverse))
    return got


class Rolling:
    """Hashes of any substrings of a text."""

    def __init__(self, text: np.ndarray, which: int = 0):
        power, self.inverse = _powers(len(text), which)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[which][text] * power[: len(text)], dtype=np.uint64)))

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def runs(text: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows in runs with one core: first starts, last starts, places of the anchors, and hashes of the cores.

    end: of each byte's document, which windows do not pass.
    """
    n = len(text)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    rolling = Rolling(text)
    places = length - GRAM + 1
    least = rolling.all(GRAM) >> np.uint64(32) << np.uint64(32) | np.arange(n - GRAM + 1, dtype=np.uint64)
    span = 1
    while span * 2 <= places:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < places:
        least = np.minimum(least[: n - length + 1], least[places - span : places - span + n - length + 1])
    start = np.flatnonzero(end[: n - length + 1] - np.arange(n - length + 1) >= length)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    half = (length - GRAM) // 2
    far = anchor - start > half
    new = np.concatenate(([True], (np.diff(start) != 1) | (np.diff(anchor) != 0) | (far[1:] != far[:-1])))
    at = np.flatnonzero(new)
    first, anchor, far = start[at], anchor[at], far[at]
    last = start[np.concatenate((at[1:], [len(start)])) - 1]
    near_core, far_core = length - half, half + 1 + GRAM
    key = np.empty(len(at), np.uint64)
    key[~far] = rolling.at(anchor[~far], near_core)
    key[far] = ~rolling.at(anchor[far] - half - 1, far_core)
    return first, last, anchor, key


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text in order of their first ``length`` letters at least, and the codes of the 8 letters at each place.

    Bucket-pointer refinement: buckets of equal q-grams are taken in order, some at a time; their suffixes are sorted by
    the bucket pointers q letters later, which are those that earlier buckets have refined already, and what is still
    together is refined again, further on, before the next buckets are begun.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    code = np.zeros(n + 8, np.uint64)
    for j in range(8):
        code[:n] = code[:n] << np.uint64(8) | padded[j : j + n]
    order = np.argsort(code[:n])
    fresh = np.concatenate(([True], code[order][1:] != code[order][:-1]))
    pointer = np.empty(n + max(length, GRAMS) + 8, np.int64)
    pointer[n:] = -1
    pointer[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))

    def split(open_: np.ndarray, offset: int) -> np.ndarray:
        """Sort suffixes of whole buckets by the pointers at an offset; returns those still together with others."""
        later = pointer[open_ + offset]
        by = np.argsort(pointer[open_] * (n + 2) + later)
        sub, later = open_[by], later[by]
        own = pointer[sub]
        bucket = np.concatenate(([True], own[1:] != own[:-1]))
        part = bucket | np.concatenate(([True], later[1:] != later[:-1]))
        k = np.arange(len(sub))
        head = np.maximum.accumulate(np.where(bucket, k, 0))
        order[own + k - head] = sub
        pointer[sub] = own + np.maximum.accumulate(np.where(part, k, 0)) - head
        size = np.diff(np.concatenate((np.flatnonzero(part), [len(sub)])))
        return sub[np.repeat(size > 1, size)]

    size = np.diff(np.concatenate((np.flatnonzero(fresh), [n])))
    open_ = order[np.repeat(size > 1, size)]
    q = 8
    while q < GRAMS and len(open_):  # q-grams of twice the letters
        open_ = split(open_, q)
        q *= 2
    at = 0
    while at < len(open_) and q < length:
        to = min(at + CHUNK, len(open_))
        if to < len(open_):
            own = pointer[open_[to - 1]]
            to += int(np.searchsorted(pointer[open_[to:]], own, side="right"))
        chunk, offset = open_[at:to], q
        while len(chunk) and offset < length:
            chunk = split(chunk, offset)
            offset += q
        at = to
    return order, code


def equal_at(text: np.ndarray, one: np.ndarray, two: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at two lists of places are equal, letter by letter."""
    same = np.ones(len(one), bool)
    for j in range(length):
        same &= text[one + j] == text[two + j]
    return same


def equal_windows(text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For each window its class of equal ones: neighbours in the suffix array whose common prefix is long enough, byte by byte."""
    order, code = suffix_order(text, length)
    one, two = order[:-1], order[1:]
    same = np.maximum(one, two) + length <= len(text)
    at = np.flatnonzero(same)
    for j in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        at = at[code[one[at] + j] == code[two[at] + j]]
    same = np.zeros(len(text), bool)
    same[at + 1] = True
    classes = np.empty(len(text), np.int64)
    classes[order] = np.cumsum(~same)
    return classes[start]


def first_of(classes: np.ndarray) -> np.ndarray:
    """Whether each member is the first of its class."""
    out = np.zeros(len(classes), bool)
    out[np.unique(classes, return_index=True)[1]] = True
    return out


def pieces(covered: np.ndarray, start: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts and ends of the bytes under covered windows that follow each other."""
    at = np.flatnonzero(covered)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    d, s = doc[at], start[at]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)))
    first = np.flatnonzero(new)
    return d[first], s[first], s[np.concatenate((first[1:], [len(at)])) - 1] + length


class Group:
    """The documents of one group in a fixed order: by id, then text. Equal rows are one document."""

    def __init__(self, blobs):
        rows = [r for b in blobs for r in unpack(b)]
        rows.sort()
        self.rows = rows
        self.docs, self.of = [], []
        for r in rows:
            if not self.docs or r != self.docs[-1]:
                self.docs.append(r)
            self.of.append(len(self.docs) - 1)

    def blocks(self):
        """Concatenated texts of several documents: (first document, text, offsets)."""
        k = 0
        while k < len(self.docs):
            j, size = k, 0
            while j < len(self.docs) and (j == k or size + len(self.docs[j][1]) <= BLOCK):
                size += len(self.docs[j][1])
                j += 1
            bodies = [d[1] for d in self.docs[k:j]]
            yield k, np.frombuffer(b"".join(bodies), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
            k = j

    def runs(self, length: int):
        """For each block: first document, text, offsets, and its runs."""
        for k, text, offset in self.blocks():
            end = np.repeat(offset[1:], np.diff(offset))
            yield k, text, offset, runs(text, end, length)


def packed(docs: DataFrame, groups: int, doc_id: str, text: str) -> DataFrame:
    """The documents as compressed blobs (db, blob), dealt to groups by a hash of id and text."""
    schema = pa.schema([("db", pa.int32()), ("blob", pa.binary())])

    def run(it):
        for batch in it:
            held = defaultdict(list)
            for g, i, body in zip(*rows_of(batch, "db", "doc_id", "body"), strict=True):
                held[g].append((NONE if i is None else i, body or b""))
            keys = list(held)
            yield from batches({"db": keys, "blob": [pack(held[k]) for k in keys]}, schema)

    group = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(groups)).cast("int")
    return docs.select(group.alias("db"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body")).mapInArrow(run, "db int, blob binary")


def covered(parts: DataFrame, groups: int, length: int) -> DataFrame:
    """db and blobs of (documents, starts, ends) of the repeated bytes of each group's documents."""

    def keys_of(key, frame):
        tidy()
        group = Group(frame["blob"])
        keys = np.concatenate([np.zeros(0, np.uint64), *(r[3] for *_, r in group.runs(length))])
        part = (keys % np.uint64(groups)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(groups + 1))
        used = np.flatnonzero(np.diff(cuts))
        return pd.DataFrame({"kb": used.astype(np.int32), "db": np.full(len(used), key[0], np.int32), "blob": [keys[order[cuts[k] : cuts[k + 1]]].tobytes() for k in used]})

    def repeated(key, frame):
        keys = [np.frombuffer(b, np.uint64) for b in frame["blob"]]
        _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        level = ((count > 1).astype(np.uint8) + (count > COMMON).astype(np.uint8))[inverse]
        cuts = np.cumsum([0, *map(len, keys)])
        out = [pack(level[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        return pd.DataFrame({"db": frame["db"], "kb": frame["kb"], "blob": out})

    levels = parts.groupBy("db").applyInPandas(keys_of, "kb int, db int, blob binary").groupBy("kb").applyInPandas(repeated, "db int, kb int, blob binary")

    def surroundings(key, docs, marks):
        """kind 0: places of repeated cores with their texts, or single windows of common cores; 2: pieces found here."""
        tidy()
        group = Group(docs["blob"])
        found = {k: unpack(b) for k, b in zip(marks["kb"], marks["blob"], strict=True)}
        used = dict.fromkeys(found, 0)
        send: dict[int, list] = defaultdict(list)
        seen: set[bytes] = set()  # windows of common cores
        own: list[tuple] = []
        for k, text, offset, (first, last, anchor, keys) in group.runs(length):
            part = (keys % np.uint64(groups)).astype(np.int64)
            level = np.zeros(len(keys), np.uint8)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                p = int(part[order[a]])
                level[order[a:b]] = found[p][used[p] : used[p] + b - a]
                used[p] += b - a
            at = np.flatnonzero(level == 1)
            doc = np.searchsorted(offset, first, side="right") - 1
            body = text.tobytes()
            for i, p, key_, d, f, l, n in zip(at.tolist(), part[at].tolist(), keys[at].tolist(), doc[at].tolist(), first[at].tolist(), last[at].tolist(), anchor[at].tolist(), strict=True):
                send[p].append((key_, k + d, f - int(offset[d]), n - f, body[f : l + length]))
            at = np.flatnonzero(level == 2)
            if len(at):
                size = last[at] - first[at] + 1
                start = np.repeat(first[at], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                d = np.repeat(doc[at], size)
                h = Rolling(text).at(start, length)
                by = np.argsort(h, kind="stable")  # in order of place where equal
                new = np.concatenate(([True], h[by][1:] != h[by][:-1]))
                head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
                gone = ~new & equal_at(text, start[by], start[head], length)
                again = np.zeros(len(h), bool)
                again[by[gone]] = True
                for j in by[~gone].tolist():
                    w = body[start[j] : start[j] + length]
                    if w in seen:
                        again[j] = True
                    else:
                        seen.add(w)
                        key_ = int(h[j])
                        send[key_ % groups].append((key_, k + int(d[j]), int(start[j] - offset[d[j]]), 0, w))
                if again.any():
                    own.append(pieces(again, start - offset[d], k + d, length))
        ids = np.array([d[0] for d in group.docs], np.int64)
        rows = [(-1, 2, pack(tuple(np.concatenate(x) for x in zip(*own, strict=True))))] if own else []
        for p, got in send.items():
            key_, d, s, rel, ctx = zip(*got, strict=True)
            d = np.array(d, np.int32)
            blob = np.array(key_, np.uint64), d, ids[d], np.array(s, np.int64), np.array(rel, np.uint8 if length < 256 else np.int32), np.array([len(c) for c in ctx], np.int32), b"".join(ctx)
            rows.append((p, 0, pack(blob)))
        return pd.DataFrame({"kb": [r[0] for r in rows], "db": key[0], "kind": [r[1] for r in rows], "blob": [r[2] for r in rows]}).astype({"kb": "int32", "db": "int32", "kind": "int32"})

    sent = parts.groupBy("db").cogroup(levels.groupBy("db")).applyInPandas(surroundings, "kb int, db int, kind int, blob binary")

    def earliest(key, frame):
        """The repeats among what has met here, as pieces for each group of documents."""
        tidy()
        out: dict[int, list] = defaultdict(list)
        texts = frame[frame["kind"] == 0]
        got = []
        bodies: list[bytes] = []
        for db, blob in zip(texts["db"], texts["blob"], strict=True):
            k, d, i, s, rel, size, body = unpack(blob)
            got.append((k, np.full(len(k), db, np.int32), d, i, s, rel))
            at = 0
            for n in size.tolist():
                bodies.append(body[at : at + n])
                at += n
        if bodies:
            keys, dbs, docs, ids, starts, rels = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            order = np.lexsort((starts, docs, dbs, ids))
            seen: set[tuple] = set()
            again = np.zeros(len(order), bool)
            for x, rel in zip(order.tolist(), rels[order].tolist(), strict=True):
                t = (rel, bodies[x])
                if t in seen:
                    again[x] = True
                else:
                    seen.add(t)
            seen.clear()
            lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
            x = np.flatnonzero(again)
            for g in np.unique(dbs[x]).tolist():
                y = x[dbs[x] == g]
                out[g] += zip(docs[y].tolist(), starts[y].tolist(), (starts[y] + lengths[y]).tolist(), strict=True)
            chosen = order[~again[order]]
            chosen = chosen[np.argsort(keys[chosen], kind="stable")]  # places of one core together, the earliest first
            one = np.concatenate(([True], keys[chosen][1:] != keys[chosen][:-1])) if len(chosen) else np.zeros(0, bool)
            alone = one & np.concatenate((one[1:], [True]))
            chosen, head = chosen[~alone], np.flatnonzero(one[~alone])
            total = np.concatenate(([0], np.cumsum(lengths[chosen])))
            ends, at = np.append(head[1:], len(chosen)), 0
            while at < len(chosen):  # whole cores in blocks, so that the suffix array stays small
                fits = ends[(ends > at) & (total[ends] - total[at] <= SORTED)]
                to = int(fits[-1] if len(fits) else ends[ends > at][0])
                block = chosen[at:to]
                size = lengths[block]
                offset = np.cumsum(size) - size
                count = size - length + 1
                inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                text = np.frombuffer(b"".join(bodies[x] for x in block.tolist()), np.uint8)
                gone = ~first_of(equal_windows(text, np.repeat(offset, count) + inner, length))
                own = np.repeat(np.arange(len(block)), count)
                for j, a, b in zip(*(v.tolist() for v in pieces(gone, starts[block][own] + inner, own, length)), strict=True):
                    x = block[j]
                    out[int(dbs[x])].append((int(docs[x]), a, b))
                at = to
        keys = list(out)
        return pd.DataFrame({"db": np.array(keys, np.int32), "blob": [pack(tuple(np.array(v, np.int64) for v in zip(*out[k], strict=True))) for k in keys]})

    return sent.withColumn("kb", F.when(F.col("kind") == 2, F.col("db")).otherwise(F.col("kb"))).groupBy("kb").applyInPandas(lambda key, frame: _with_own(earliest(key, frame), frame), "db int, blob binary")


def _with_own(found: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
    own = frame[frame["kind"] == 2][["db", "blob"]]
    return pd.concat([found, own], ignore_index=True) if len(own) else found


def spans_of(blobs, sizes: np.ndarray) -> list[np.ndarray]:
    """For each document of a group its maximal repeated spans, as rows of start and end."""
    out = [np.zeros((0, 2), np.int64)] * len(sizes)
    parts = [unpack(b) for b in blobs]
    if not parts:
        return out
    d, a, b = (np.concatenate([p[j] for p in parts]) for j in range(3))
    if not len(d):
        return out
    base = np.concatenate(([0], np.cumsum(sizes + 1)))
    order = np.lexsort((a, d))
    d, lo, hi = d[order], (base[d] + a)[order], (base[d] + b)[order]
    top = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > top[:-1]))
    first = np.flatnonzero(new)
    d, lo, hi = d[first], lo[first], top[np.concatenate((first[1:], [len(lo)])) - 1]
    for x, y, z in zip(d.tolist(), (lo - base[d]).tolist(), (hi - base[d]).tolist(), strict=True):
        out[x] = np.concatenate((out[x], [[y, z]]))
    return out


def without(body: bytes, spans: np.ndarray) -> bytes:
    edge = [0, *spans.ravel().tolist(), len(body)]
    return b"".join(body[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def _apply(docs: DataFrame, length: int, doc_id: str, text: str, schema: str, rows_for) -> DataFrame:
    groups = group_count(docs, text)
    parts = packed(docs, groups, doc_id, text)

    def result(key, blobs, found):
        tidy()
        group = Group(blobs["blob"])
        spans = spans_of(found["blob"], np.array([len(d[1]) for d in group.docs], np.int64))
        return rows_for(group, spans)

    return parts.groupBy("db").cogroup(covered(parts, groups, length).groupBy("db")).applyInPandas(result, schema)


def repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (flat starts and ends, in bytes) of every row.

    A byte is removed if a string of ``length`` bytes over it also starts earlier: in a smaller doc_id or earlier in the
    same text. Null doc_ids come first. Rows with equal doc_id and text are one document, each with the same result;
    among different texts of one doc_id a fixed order decides. Null and empty texts have nothing to remove. Other
    columns are not read.
    """

    def rows_for(group, spans):
        out = []
        for i, k in zip((r[0] for r in group.rows), group.of, strict=True):
            body, s = group.docs[k][1], spans[k]
            out.append((None if i == NONE else i, len(body), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(without(body, s)).hexdigest(), s.ravel().tolist()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        return frame.astype({"doc_id": "Int64"})

    return _apply(docs, length, doc_id, text, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>", rows_for)


def clean(docs: DataFrame, length: int = 100) -> DataFrame:
    """The documents with repeated bytes cut out of ``text``; letters that a cut halves go with it. A null text stays."""

    def rows_for(group, spans):
        new = [without(d[1], s).decode("utf-8", "ignore") for d, s in zip(group.docs, spans, strict=True)]
        ids = [None if d[0] == NONE else d[0] for d in group.docs]
        frame = pd.DataFrame({"_id": ids, "_size": [len(d[1]) for d in group.docs], "_md5": [hashlib.md5(d[1]).hexdigest() for d in group.docs], "_new": new})
        return frame.astype({"_id": "Int64"})[[bool(len(s)) for s in spans]]

    changed = _apply(docs, length, "doc_id", "text", "_id long, _size long, _md5 string, _new string", rows_for)
    same = docs["doc_id"].eqNullSafe(changed["_id"]) & (F.md5(docs["text"].cast("binary")) == changed["_md5"])
    new = F.coalesce(changed["_new"], docs["text"]).alias("text")
    return docs.join(changed, same, "left").select(*[new if c == "text" else docs[c] for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes in all documents."""
    return repeats(table(spark, sf_dir, "documents"), 100).drop("spans")
