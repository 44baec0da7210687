"""Quality rules with suffix-array repetition.

The words of a block of documents are put in a suffix array (prefix doubling, documents kept apart). The intervals of its
longest common prefixes (Kasai's walk) are the repeated word sequences that go on differently; those that also follow
different words are the maximal ones. A document fails where the union of their spans covers too much of it or the longest
one is too long. A text takes about 250 bytes a word, however repetitive it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, rows_of, table

#: Words of several documents that one suffix array holds; a longer document has one of its own.
BLOCK_WORDS = 200_000
_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\r\x0b\x0c"


def suffix_order(code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``code``, suffixes ending at ``end``, and which suffixes share their first two symbols with others.

    Codes must differ between documents. Only the suffixes whose bucket still holds others are sorted again.
    """
    n = len(code)
    place = np.arange(n)
    order = np.argsort(code, kind="stable")
    first = np.concatenate(([True], code[order][1:] != code[order][:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    step, open_, shared = 1, np.arange(n), np.zeros(n, bool)
    while True:
        held = np.bincount(rank, minlength=n)
        open_ = open_[held[rank[open_]] > 1]
        if step == 2:
            shared[open_] = True
        if not len(open_):
            break
        ahead = open_ + step
        second = np.where(ahead < end[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(rank[open_] * (n + 1) + second, kind="stable")
        sub = open_[by]
        old, new = rank[sub], second[by]
        at = np.arange(len(sub))
        group = np.concatenate(([True], old[1:] != old[:-1]))
        part = group | np.concatenate(([True], new[1:] != new[:-1]))
        begin = np.maximum.accumulate(np.where(group, at, 0))
        rank[sub] = old + np.maximum.accumulate(np.where(part, at, 0)) - begin
        step *= 2
    order[rank] = place
    return order, shared


def common_prefix(code: np.ndarray, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The longest common prefix of each suffix with the one before it in the suffix array, 0 where it is under 2.

    Kasai's walk along the text: a suffix shares at most one symbol less than the one before it in the text, so symbols
    are compared twice at most, and only suffixes that share two symbols with others are walked.
    """
    n = len(code)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, dtype=np.int64)
    text, previous, out = memoryview(np.ascontiguousarray(code, dtype=np.int64)), memoryview(before), memoryview(found)
    last, size = -2, 0
    for i in np.flatnonzero(shared).tolist() if n < 1 << 20 else map(int, np.flatnonzero(shared)):
        size = size - 1 if i == last + 1 and size > 0 else 0
        last = i
        j = previous[i]
        if j < 0:
            size = 0
            continue
        top = n - (i if i > j else j)
        while size < top and text[i + size] == text[j + size]:
            size += 1
        out[i] = size
    return found[order]


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest-common-prefix intervals of ``least`` symbols or more: the prefix's length, and the first and last place in the suffix array."""
    size, first, last = [], [], []
    stack: list[tuple[int, int]] = []
    at = np.flatnonzero(lcp >= least)
    previous = -2
    for k, v in zip(at.tolist(), lcp[at].tolist(), strict=True):
        begin = k - 1
        if k != previous + 1:
            while stack:
                length, start = stack.pop()
                size.append(length)
                first.append(start)
                last.append(previous)
        while stack and stack[-1][0] > v:
            length, begin = stack.pop()
            size.append(length)
            first.append(begin)
            last.append(k - 1)
        if not stack or stack[-1][0] < v:
            stack.append((v, begin))
        previous = k
    while stack:
        length, start = stack.pop()
        size.append(length)
        first.append(start)
        last.append(previous)
    return tuple(np.array(x, dtype=np.int64) for x in (size, first, last))


def maximal(code: np.ndarray, begins: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which intervals cannot be lengthened to the left: their occurrences follow different symbols, or one begins a document."""
    left = np.where(begins[order], -1 - np.arange(len(order)), code[np.maximum(order - 1, 0)])
    changes = np.cumsum(np.concatenate(([0], left[1:] != left[:-1])))
    return changes[last] > changes[first]


def repetition(docs: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document of word numbers: words under the union of maximal repeats of ``least`` words or more, the longest
    repeat, and words in three-word windows that occur twice or more."""
    size = np.array([len(d) for d in docs], dtype=np.int64)
    n = int(size.sum())
    out = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    if not n:
        return out
    code = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), size)
    end = np.repeat(np.cumsum(size), size)
    spread = int(code.max()) + 1
    code = doc * spread + code
    order, shared = suffix_order(code, end)
    lcp = common_prefix(code, order, shared)
    begins = np.zeros(n, bool)
    begins[(np.cumsum(size) - size)[size > 0]] = True
    word, times = np.unique(code, return_counts=True)
    out[1][word[times > 1] // spread] = 1
    length, first, last = intervals(lcp, 2)
    kept = maximal(code, begins, order, first, last)
    np.maximum.at(out[1], doc[order[first[kept]]], length[kept])
    inner = np.maximum(lcp, np.append(lcp[1:], 0))  # of each place in the suffix array, its innermost interval
    for least_, to in ((least, out[0]), (3, out[2])):
        at = np.flatnonzero(inner >= least_)  # repeats that are not maximal lie inside those that are
        edge = np.bincount(order[at], minlength=n + 1) - np.bincount(order[at] + (inner[at] if to is out[0] else 3), minlength=n + 1)
        np.add.at(to, doc[np.cumsum(edge)[:n] > 0], 1)
    return out


def rules(docs: DataFrame, least: int = 8, max_fraction: float = 0.3, max_repeat: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_fraction, longest_repeat.

    ``kept`` is false if the base rules fail (under 50 words, or over half of the words in repeated three-word windows),
    if repeats of ``least`` words or more cover over ``max_fraction`` of the words, or if one is over ``max_repeat`` words.
    A null or empty text has no words, so it fails. Repeated rows each get their row; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_fraction", pa.float64()), ("longest_repeat", pa.int64())])

    def block(ids: list, bodies: list[bytes]) -> dict[str, list]:
        got = {f.name: [] for f in schema}
        number: dict[bytes, int] = {}
        tokens = []
        for i, body in zip(ids, bodies, strict=True):
            w = body.split()
            tokens.append(np.array([number.setdefault(x, len(number)) for x in w], dtype=np.int64))
            lines = [x for x in body.split(b"\n") if x.strip()]
            got["doc_id"].append(i)
            got["n_words"].append(len(w))
            got["word_chars"].append(len(body.translate(None, _WHITE).decode("utf-8", "replace")))
            got["n_symbols"].append(len(body) - len(body.translate(None, _SYMBOLS)))
            got["n_dup_lines"].append(len(lines) - len(set(lines)))
        covered, longest, repeated = repetition(tokens, least)
        n = np.array(got["n_words"], dtype=np.int64)
        failed = (n < 50) | (100 * repeated > 50 * n)
        fraction = covered / np.maximum(n, 1)
        got["n_repeat_words"], got["longest_repeat"], got["covered_fraction"], got["base_failed"] = repeated, longest, fraction, failed
        got["kept"] = ~failed & (fraction <= max_fraction) & (longest <= max_repeat)
        return got

    def run(it):
        for batch in it:
            ids, bodies = rows_of(batch, "doc_id", "body")
            start, held = 0, 0
            for k, body in enumerate(bodies):
                count = len(body or b"") // 6
                if k > start and held + count > BLOCK_WORDS:
                    yield from batches(block(ids[start:k], [b or b"" for b in bodies[start:k]]), schema)
                    start, held = k, 0
                held += count
            yield from batches(block(ids[start:], [b or b"" for b in bodies[start:]]), schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body")).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    return rules(table(spark, sf_dir, "documents")).drop("covered_fraction", "longest_repeat")
