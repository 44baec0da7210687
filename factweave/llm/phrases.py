"""Collocations of two to four words by suffix-sigma.

Every word of a piece starts a suffix of at most four words. Suffixes are counted batch by batch where they are read, meet
by language and first word, are sorted in reverse order, and one stack counts all their prefixes. Two exact savings come
first: a phrase is no more frequent than its words and pairs of words, so suffixes end where a word or pair is too rare (bit
tables of bounded size tell most rare ones), and suffixes of one word are known from the word counts. A first word with more than a
``1/HOT`` of all words is dealt to ``SALTS`` groups by the whole suffix; parts of its counts are added up afterwards.
The parts l and r of each cut are then found by joins, and so are the longer phrases that swallow shorter ones.

Null texts are empty; a null lang is ``und``; repeated rows count each time; texts of any length are read in segments
that overlap by what a suffix needs; an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, pack, rows_of, slices, table, tidy, unpack, written

LONGEST = 4
#: Bytes of text that are read at once.
SEGMENT = 4 << 20
#: A first word that makes up more than one in HOT of all words is dealt to SALTS groups; there are at most HOT such words.
HOT, SALTS = 512, 64
#: Hashes of pairs that a task holds at once.
HELD = 4 << 20
#: The most bits of a table of frequent words or pairs (64 MB).
MOST_BITS = 1 << 29

#: Separators of pieces become full stops, tabs become spaces, A-Z lower case.
_FOLD = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: floor(2000000 a / (l + r)), exact: products may pass 64 bits.
SCORE = "cast((cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)"
_NEXT = re.compile(rb"\.|[^ .]+")
_WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
_SUFFIXES = pa.schema([("lang", pa.string()), ("salt", pa.int32()), *((f"w{k}", pa.binary()) for k in range(1, LONGEST + 1)), ("n", pa.int64())])
_PARTS = pa.schema([("lang", pa.string()), ("salt", pa.int32()), ("words", pa.list_(pa.binary())), ("n", pa.int64())])


def _split(text: bytes) -> pa.Array:
    """Words and full stops of a folded text, without an object for each."""
    letters = np.frombuffer(text, np.uint8)
    keep, stop = letters != 32, letters == 46
    begins = np.flatnonzero(keep & (stop | np.concatenate(([True], ~keep[:-1] | stop[:-1])))) if len(letters) else np.zeros(0, np.int64)
    offsets = np.append(np.cumsum(keep)[begins] - 1, np.count_nonzero(keep)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters[keep])])


def tokens(text: bytes, segment: int = SEGMENT) -> Iterator[tuple[pa.Array, int]]:
    """(tokens, own): words and full stops between pieces, in segments; those from ``own`` on belong to the next segment."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        to = min(at + segment, len(text))
        if to < len(text):  # not inside a word
            stops = [x for x in (text.find(b" ", to), text.find(b".", to)) if x >= 0]
            to = min(stops, default=len(text))
        own = _split(text[at:to])
        ahead = []
        for m in _NEXT.finditer(text, to):
            ahead.append(m[0])
            if m[0] == b"." or len(ahead) == LONGEST - 1:
                break
        yield pa.concat_arrays([own, pa.array(ahead, pa.binary())]), len(own)
        at = to


def _coded(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    """(lang, codes, own, words) of each language of a batch: texts together up to a segment, longer ones by segments; -1 stands between pieces, own marks starts."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(*rows_of(batch, "lang", "text"), strict=True):
        by_lang.setdefault("und" if lang is None else lang, []).append((text or "").encode("utf-8", "surrogatepass"))
    for lang, texts in by_lang.items():
        held, size = [], 0
        for text in texts:
            if len(text) > SEGMENT:
                for part, n in tokens(text):
                    yield lang, *_codes(part, np.arange(len(part)) < n)
                continue
            held.append(text)
            size += len(text)
            if size > SEGMENT:
                yield lang, *_joined(held)
                held, size = [], 0
        if held:
            yield lang, *_joined(held)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    found = _split(b".".join(texts).translate(_FOLD))
    return _codes(found, np.ones(len(found), bool))


def _codes(found: pa.Array, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    coded = found.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    stop = coded.dictionary.index(pa.scalar(b".", pa.binary())).as_py()
    return np.where(codes == stop, -1, codes), own, coded.dictionary


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(it, 1):
        for lang, codes, own, names in _coded(batch):
            n = np.bincount(codes[own & (codes >= 0)], minlength=len(names))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), names.take(pa.array(at)), pa.array(n[at])], schema=_WORDS)
    tidy()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word."""
    said = docs.select("lang", "text").mapInArrow(_count_words, "lang string, word binary, n long")
    return said.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Spark's 64-bit hashes of words, crossed with their language's."""
    own = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)) ^ own


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A bit table of hashes (h): 16 bits for each, at most MOST_BITS, so that others are told apart but for chance hits."""
    bits = min(MOST_BITS, 1 << max(16, (16 * hashes.count()).bit_length()))
    place = F.pmod(F.col("h"), F.lit(bits))
    cells = hashes.select(place.alias("p")).groupBy(F.expr("p div 32").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("cell")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[cells["at"].to_numpy()] = cells["cell"].to_numpy().astype(np.uint32)
    return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & h.dtype.type(len(bits) * 32 - 1)  # a power of two
    return bits[(h >> h.dtype.type(5)).astype(np.int64)] >> (h & h.dtype.type(31)).astype(np.uint32) & 1 > 0


def frequent(words: DataFrame, least: int) -> np.ndarray:
    """The bit table of words with ``least`` occurrences or more."""
    h = F.xxhash64("word").bitwiseXOR(F.xxhash64(F.encode("lang", "UTF-8")))
    return bit_table(words.filter(F.col("n") >= least).select(h.alias("h")))


def _pairs(lang: str, codes: np.ndarray, names: pa.Array, often: np.ndarray, keep: int) -> np.ndarray:
    """A hash of ``keep`` bits for each word and the next; -1 unless both may be frequent."""
    value = np.append(_hashes(lang, names.to_pylist()), np.uint64(0))
    known = _has(often, value)
    known[-1] = False
    word, ok = value[codes], known[codes]
    out = np.full(len(codes), -1)
    both = np.flatnonzero(ok[:-1] & ok[1:] & (codes[:-1] >= 0) & (codes[1:] >= 0))
    out[both] = (mix(word[both] * np.uint64(0x9E3779B97F4A7C15) + mix(word[both + 1])) >> np.uint64(64 - keep)).astype(np.int64)
    return out


def _kept(total: int) -> int:
    """Bits of a pair's hash by the number of words: two pairs with one hash only count as more frequent."""
    return min(62, max(24, total.bit_length() + 6))


def frequent_pairs(docs: DataFrame, often: np.ndarray, least: int, total: int) -> np.ndarray:
    """The bit table of word pairs with ``least`` occurrences or more, counted by hashes that are dealt by range."""
    sent = docs.sparkSession.sparkContext.broadcast(often)
    keep = _kept(total)
    deal = min(keep, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // HELD).bit_length() + 1)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(it, 1):
            for lang, codes, own, names in _coded(batch):
                found = _pairs(lang, codes, names, sent.value, keep)
                held.append(np.unique(found[own & (found >= 0)], return_counts=True))
            if sum(len(h) for h, _ in held) > HELD:
                yield from _dealt(*_added(held), keep - deal)
                held = []
        yield from _dealt(*_added(held), keep - deal)
        tidy()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs come sorted by part; those of one part are added up, some at a time."""
        part, held = None, []

        def told() -> pa.RecordBatch:
            h, n = _added(held)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= least])], names=["h"])

        for batch in it:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    if held:
                        yield told()
                    part, held = p, []
                gaps, n = unpack(blob)
                held.append((np.cumsum(gaps, dtype=np.int64), n))
                if len(held) > 1 and sum(len(h) for h, _ in held) > 2 * len(held[0][0]) + HELD:
                    held = [_added(held)]
        if held:
            yield told()
        tidy()

    blobs = docs.select("lang", "text").mapInArrow(count, "part long, blob binary")
    return bit_table(written(blobs.repartition("part").sortWithinPartitions("part").mapInArrow(add, "h long")))


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by hash, in order."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n[order], first) if len(h) else n


def _dealt(h: np.ndarray, n: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
    part = h >> shift
    bounds = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(h)).tolist()
    if len(h):
        blobs = [pack((np.diff(h[a:b], prepend=0), n[a:b].astype(np.min_scalar_type(n[a:b].max())))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]]), pa.array(blobs, pa.binary())], names=["part", "blob"])


def suffixes(docs: DataFrame, often: np.ndarray, pairs: np.ndarray, keep: int, hot: dict[str, set[bytes]]) -> DataFrame:
    """(lang, salt, w1, ..., w4, n): counted suffixes of two words or more, cut before rare pairs; salt -1 unless w1 is hot."""
    sent = docs.sparkSession.sparkContext.broadcast((often, pairs, hot))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_, pairs_, hot_ = sent.value
        for batch in slices(it, 1):
            for lang, codes, own, names in _coded(batch):
                found = _pairs(lang, codes, names, often_, keep)
                known = np.append((found >= 0) & _has(pairs_, np.maximum(found, 0)), np.zeros(LONGEST, bool))
                padded = np.append(codes, np.full(LONGEST, -1))
                start = np.flatnonzero(own & known[: len(codes)])
                if not len(start):
                    continue
                cols, goes = [codes[start]], np.ones(len(start), bool)
                for k in range(1, LONGEST):
                    goes = goes & known[start + k - 1]
                    cols.append(np.where(goes, padded[start + k], -1))
                size = len(names) + 1
                left, right = cols[0] * size + cols[1], (cols[2] + 1) * (size + 1) + cols[3] + 1
                order = np.lexsort((right, left))
                left, right = left[order], right[order]
                first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
                n = np.diff(np.append(first, len(order)))
                rows = order[first]
                w = [names.take(pa.array(c[rows], mask=c[rows] < 0)) for c in cols]
                salt = np.full(len(rows), -1, np.int32)
                if lang in hot_:
                    is_hot = np.array([x in hot_[lang] for x in names.to_pylist()])[cols[0][rows]]
                    for at in np.flatnonzero(is_hot).tolist():
                        salt[at] = zlib.crc32(b"\t".join(c[at].as_py() or b"" for c in w)) % SALTS
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(salt), *w, pa.array(n)], schema=_SUFFIXES)
        tidy()

    return docs.select("lang", "text").mapInArrow(cut, "lang string, salt int, w1 binary, w2 binary, w3 binary, w4 binary, n long")


def _prefixes(least: int):
    """Counts of all prefixes of two words or more of suffixes in reverse order: one stack of the current suffix's words."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[bytes] = []
        counts: list[int] = []
        group = (None, None)
        out: list[tuple] = []

        def pop(to: int) -> None:
            while len(stack) > to:
                n = counts.pop()
                if len(stack) > 1 and (n >= least or group[1] >= 0):
                    out.append((*group, tuple(stack), n))
                if counts:
                    counts[-1] += n
                stack.pop()

        def told() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, _PARTS, strict=True)], schema=_PARTS)

        for batch in it:
            for lang, salt, *words, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, salt) != group:
                    pop(0)
                    group = (lang, salt)
                same = 0
                while same < len(stack) and words[same] == stack[same]:
                    same += 1
                pop(same)
                for w in words[same:]:
                    if w is None:
                        break
                    stack.append(w)
                    counts.append(0)
                counts[-1] += n
            if len(out) > 50_000:
                yield told()
        pop(0)
        yield told()

    return count


def phrase_counts(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, words, n) for every phrase of two to four words with ``least`` occurrences or more."""
    total = words.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, set[bytes]] = {}
    for r in words.filter(F.col("n") > max(least, total // HOT)).select("lang", "word").collect():  # at most HOT rows
        hot.setdefault(r["lang"], set()).add(bytes(r["word"]))
    columns = [f"w{k}" for k in range(1, LONGEST + 1)]
    often = frequent(words, least)
    met = suffixes(docs, often, frequent_pairs(docs, often, least, total), _kept(total), hot).repartition("lang", "w1", "salt").sortWithinPartitions(*(F.desc(c) for c in ("w1", "lang", "salt", *columns[1:])))
    parts = met.mapInArrow(_prefixes(least), "lang string, salt int, words array<binary>, n long")
    return parts.groupBy("lang", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def collocations(docs: DataFrame, least: int = 30, swallow: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases that no longer one swallows.

    A phrase is swallowed by a longer candidate around it with ``swallow`` percent of its occurrences or more.
    """
    words = written(word_counts(docs))
    long = written(phrase_counts(docs, words, least))
    single = words.filter(F.col("n") >= least).select("lang", F.array("word").alias("words"), "n")
    counts = single.unionByName(long)
    size = F.size("words")
    cuts = long.select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "a", "k", F.expr("slice(words, 1, k)").alias("first"), F.expr("slice(words, k + 1, size(words))").alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("words").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("words").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    scored = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inside = F.expr("filter(flatten(transform(sequence(2, greatest(size(words) - 1, 2)), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m)))), s -> size(s) < size(words))")
    longer = long.filter(size > 2).select("lang", F.explode(inside).alias("words"), F.col("n").alias("most")).groupBy("lang", "words").agg(F.max("most").alias("most"))
    swallowed = F.expr(f"cast(100 as decimal(38,0)) * most >= cast({int(swallow)} as decimal(38,0)) * a")
    left = scored.join(longer, ["lang", "words"], "left").filter(F.col("most").isNull() | ~swallowed)
    phrase = F.array_join(F.transform("words", lambda w: F.decode(w, "UTF-8")), " ")
    flat = left.select("lang", phrase.alias("phrase"), "a", "c.l", "c.r", "c.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = flat.withColumn("salt", F.crc32(F.encode("phrase", "UTF-8")) % SALTS).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
