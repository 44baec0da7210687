"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are counted over the whole training part. The top of the neural vocabulary is the most frequent words and, for all
others, classes by their ending. Inside a class every word that is frequent enough has a vector of its own, so the
vocabulary grows with the corpus; these words are in blocks, and a class chooses a block, or the rest of its words, and a
block a word, each by the same predicted vector and exactly normalised. Words of the rest have their smoothed relative
frequency in it. A token's score in its context of
two tokens is the product of the predicted vector (a matrix for each context place times the context word's vector) with
the token's vector, plus a bias. Every partition trains its own copy on all of its text and the copies are averaged.
For scoring, exp(score) factors over the two context places, so one matrix product gives the normaliser of every
context, and token log-probabilities are exactly normalised.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, pack, rows_of, table, unpack, words, written
from .langid import remainder

#: Stands for the end of a text; no word is a line feed.
END = b"\n"
#: Words and endings of the neural vocabulary.
WORDS, ENDINGS, WIDTH = 768, 255, 16
#: Counts of at most so many frequent tokens are broadcast (12 bytes each); all others are joined.
HEAD = 1_000_000
BATCH, NOISE, RATE = 1024, 32, 0.1
#: Words with a vector inside their class occur so often at least; the model holds the most frequent ones, MEMBERS at most
#: (3 MB), in blocks of so many words. Noise words inside a class for each word.
LEAST, MEMBERS, IN_BLOCK, INSIDE_NOISE = 8, 40_000, 32, 1
_TYPES = 300_000
#: Copies of the model that are averaged at once.
MERGED = 16


def counted(docs: DataFrame) -> DataFrame:
    """token (binary) and c of all texts, an end for each; written to the shared folder."""
    schema = pa.schema([("token", pa.binary()), ("c", pa.int64())])

    def count(it):
        got: Counter = Counter()
        for batch in it:
            for body in batch.column(0).to_pylist():
                got.update(words(body or b""))
                got[END] += 1
                if len(got) > _TYPES:
                    yield from batches({"token": list(got), "c": list(got.values())}, schema)
                    got = Counter()
        yield from batches({"token": list(got), "c": list(got.values())}, schema)

    return written(docs.select(F.col("text").cast("binary")).mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))


@dataclass
class Groups:
    """Choices in groups that follow each other: where the groups begin, and shares that are 1 in each."""

    first: np.ndarray
    share: np.ndarray

    def __post_init__(self):
        self.cum = np.concatenate(([0.0], np.cumsum(self.share)))
        self.log_noise = np.log(self.share * INSIDE_NOISE).astype(np.float32)


@dataclass
class Vocabulary:
    """The neural vocabulary: frequent words, endings, and one class for the rest."""

    number: dict[bytes, int]
    ending: dict[bytes, int]
    size: int
    share: np.ndarray  # of the training tokens
    inside: np.ndarray  # N + V + 1 of each class's words without a vector; 0 for words
    member: dict[bytes, int]  # words with a vector inside their class, numbered block by block
    units: Groups  # of each class: its blocks, and last the rest of its words
    words: Groups  # of each block
    block_of: np.ndarray  # of each such word
    unit_of: np.ndarray  # of each block

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        word, end, rest = self.number.get, self.ending.get, self.size - 1
        return np.array([k if (k := word(t)) is not None else end(t[-2:], rest) for t in tokens], dtype=np.int64)

    def choices(self, tokens: list[bytes]):
        """For places among the tokens: (which of them, class, unit) of all inside a class, and (which, block, word) of those with a vector."""
        get = self.member.get
        number = np.array([get(t, -1) for t in tokens], dtype=np.int64)

        def at(ids: np.ndarray, places: np.ndarray) -> tuple[tuple, tuple]:
            k, m = ids[places], number[places]
            tail = np.flatnonzero(self.inside[k] > 0)
            own = np.flatnonzero(m >= 0)
            unit = self.units.first[k[tail] + 1] - 1
            known = m[tail] >= 0
            unit[known] = self.unit_of[self.block_of[m[tail][known]]]
            several = self.units.first[k[tail] + 1] - self.units.first[k[tail]] > 1
            return (tail[several], k[tail][several], unit[several]), (own, self.block_of[m[own]], m[own])

        at.number = number
        return at


def vocabulary(counts: DataFrame, total: int) -> Vocabulary:
    top = counts.orderBy(F.desc("c"), "token").limit(WORDS).collect()
    number = {bytes(r["token"]): i for i, r in enumerate(top)}
    if END not in number:
        number[END] = len(number)
    least = counts.filter(~F.col("token").isin([bytearray(t) for t in number]))
    ends = least.groupBy(F.expr("substring(token, -2, 2)").alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))  # at most 65 792 rows
    first = ends.orderBy(F.desc("n"), "e").limit(ENDINGS).collect()
    ending = {bytes(r["e"]): len(number) + i for i, r in enumerate(first)}
    size = len(number) + len(ending) + 1
    n, v = np.zeros(size), np.zeros(size)
    for r in top:
        n[number[bytes(r["token"])]] = r["c"]
    if (end := number[END]) >= len(top):
        n[end] = (counts.filter(F.col("token") == F.lit(bytearray(END))).agg(F.sum("c")).first()[0]) or 0
    for r in first:
        n[ending[bytes(r["e"])]], v[ending[bytes(r["e"])]] = r["n"], r["v"]
    whole = least.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n[-1], v[-1] = whole[0] - sum(r["n"] for r in first), whole[1] - sum(r["v"] for r in first)
    share = (n + 1) / (n + 1).sum()
    floor = _floor(counts, MEMBERS, LEAST)
    held = [] if floor is None else [(bytes(r["token"]), r["c"]) for r in counts.filter(_bin() >= floor).filter(F.col("c") >= LEAST).collect()]  # at most MEMBERS
    by_class: dict[int, list] = {}
    for t, c in held:
        if t not in number:
            by_class.setdefault(ending.get(t[-2:], size - 1), []).append((-c, t))
    member: dict[bytes, int] = {}
    unit_first, unit_share, word_first, word_share, block_of, unit_of = [0], [], [0], [], [], []
    for k in range(size):
        mine = sorted(by_class.get(k, ()))
        if k >= len(number):
            n[k] += sum(c for c, _ in mine)  # mine are negative: what is left is the rest
            v[k] -= len(mine)
            weights = []
            for at in range(0, len(mine), IN_BLOCK):
                block = mine[at : at + IN_BLOCK]
                total_ = -sum(c for c, _ in block)
                unit_of.append(len(unit_share) + len(weights))
                for c, t in block:
                    member[t] = len(member)
                    block_of.append(len(word_first) - 1)
                    word_share.append(-c / total_)
                word_first.append(len(member))
                weights.append(total_)
            weights = np.array([*weights, n[k] + 1.0])
            unit_share += (weights / weights.sum()).tolist()
        unit_first.append(len(unit_share))
    inside = np.where(np.arange(size) < len(number), 0.0, n + v + 1)
    units, words_ = Groups(np.array(unit_first), np.array(unit_share)), Groups(np.array(word_first), np.array(word_share))
    return Vocabulary(number, ending, size, share, inside, member, units, words_, np.array(block_of, np.int64), np.array(unit_of, np.int64))


def _bin():
    return F.floor(F.log2("c") * 8)


def _floor(counts: DataFrame, most: int, least: int = 1) -> int | None:
    """The least bin of counts down to which there are at most ``most`` tokens that occur ``least`` times; None if not even the top one fits."""
    bins = sorted(((r["b"], r["n"]) for r in counts.filter(F.col("c") >= least).groupBy(_bin().alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    floor, held = None, 0
    for b, n in bins:
        if held + n > most:
            break
        floor, held = b, held + n
    return floor


class Inside:
    """Vectors and biases of choices in groups, their AdaGrad memory, and how often each was trained."""

    def __init__(self, groups: Groups):
        self.groups, n = groups, len(groups.share)
        self.vector, self.bias = np.zeros((n, WIDTH), np.float32), np.log(groups.share).astype(np.float32)
        self.memory, self.bias_memory, self.seen = np.full((n, WIDTH), 1e-6, np.float32), np.full(n, 1e-6, np.float32), np.zeros(n, np.float32)

    def train(self, hat: np.ndarray, group: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """A noise-contrastive step, with noise from each target's own group."""
        g, n = self.groups, len(target)
        lo, hi = g.first[group], g.first[group + 1]
        u = g.cum[lo][:, None] + rng.random((len(target), INSIDE_NOISE)) * (g.cum[hi] - g.cum[lo])[:, None]
        drawn = np.clip(np.searchsorted(g.cum, u, side="right") - 1, lo[:, None], hi[:, None] - 1)
        rows = np.concatenate((target[:, None], drawn), axis=1)
        q = self.vector[rows]
        z = np.einsum("nd,nkd->nk", hat, q) + (self.bias[rows] - g.log_noise[rows])
        d = -1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d[:, 0] += 1
        uniq, inverse = np.unique(rows.ravel(), return_inverse=True)
        dv, db = np.zeros((len(uniq), WIDTH), np.float32), np.bincount(inverse, weights=d.ravel(), minlength=len(uniq)).astype(np.float32) / n
        _scatter(dv, inverse, (d[:, :, None] * hat[:, None, :]).reshape(-1, WIDTH))
        dv /= n
        self.memory[uniq] += dv * dv
        self.bias_memory[uniq] += db * db
        self.vector[uniq] += RATE * dv / np.sqrt(self.memory[uniq])
        self.bias[uniq] += RATE * db / np.sqrt(self.bias_memory[uniq])
        self.seen[uniq] += 1

    def log_chances(self, hat: np.ndarray, group: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log of the normalised chance of each target among its group."""
        out = np.zeros(len(target), np.float32)
        by = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], group[by][1:] != group[by][:-1], [True]))) if len(by) else np.zeros(1, np.int64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):  # noqa: B905
            at = by[a:b]
            lo, hi = self.groups.first[group[at[0]]], self.groups.first[group[at[0]] + 1]
            if hi - lo > 1:
                z = hat[at] @ self.vector[lo:hi].T
                z += self.bias[lo:hi]
                np.clip(z, -60, 60, out=z)
                out[at] = z[np.arange(len(at)), target[at] - lo]
                out[at] -= np.log(np.exp(z, out=z).sum(axis=1))
        return out


class LogBilinear:
    """The model: vectors of context words and targets, a matrix for each context place, and biases."""

    def __init__(self, share: np.ndarray, vocab: Vocabulary | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.inner = [Inside(vocab.units), Inside(vocab.words)] if vocab else []
        v = len(share)
        self.context = (rng.standard_normal((v + 1, WIDTH)) * 0.3).astype(np.float32)  # the last stands before a text
        self.target = (rng.standard_normal((v, WIDTH)) * 0.1).astype(np.float32)
        self.place = np.stack([np.eye(WIDTH), np.eye(WIDTH) * 0.5]).astype(np.float32)
        self.bias = np.log(share).astype(np.float32)
        self.noise = np.cumsum(share)
        self.log_noise = np.log(share * NOISE).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.place, self.bias]

    def train(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, rng: np.random.Generator, memory: list[np.ndarray]) -> None:
        """One noise-contrastive step on a batch: contexts one and two places before, and the words."""
        n = len(word)
        r1, r2 = self.context[one], self.context[two]
        hat = r1 @ self.place[0] + r2 @ self.place[1]
        drawn = np.minimum(np.searchsorted(self.noise, rng.random(NOISE)), len(self.noise) - 1)
        q, qn = self.target[word], self.target[drawn]
        true = np.einsum("ij,ij->i", hat, q) + (self.bias - self.log_noise)[word]
        false = hat @ qn.T
        false += (self.bias - self.log_noise)[drawn]
        np.clip(true, -30, 30, out=true)
        up = 1 / (1 + np.exp(true))
        np.negative(false, out=false)
        np.minimum(false, 30, out=false)
        down = np.exp(false, out=false)  # minus the chance that a noise word is taken for a true one
        down += 1
        np.divide(-1, down, out=down)
        d_hat = up[:, None] * q + down @ qn
        v = len(self.bias)
        d_target, d_bias, d_context = np.zeros_like(self.target), np.zeros_like(self.bias), np.zeros_like(self.context)
        _scatter(d_target, word, up[:, None] * hat)
        np.add.at(d_target, drawn, down.T @ hat)
        d_bias += np.bincount(word, weights=up, minlength=v).astype(np.float32) + np.bincount(drawn, weights=down.sum(axis=0), minlength=v).astype(np.float32)
        _scatter(d_context, np.concatenate((one, two)), np.concatenate((d_hat @ self.place[0].T, d_hat @ self.place[1].T)))
        d_place = np.stack([r1.T @ d_hat, r2.T @ d_hat])
        for p, g, m in zip(self.parameters(), (d_context, d_target, d_place, d_bias), memory, strict=True):
            g /= n
            m += g * g
            p += RATE * g / np.sqrt(m + 1e-10)

    def train_inside(self, one: np.ndarray, two: np.ndarray, choices, rng: np.random.Generator) -> None:
        """A step on the choices inside classes and blocks, each (which words, group, choice)."""
        hat = self.context[one] @ self.place[0] + self.context[two] @ self.place[1]
        for part, (at, group, target) in zip(self.inner, choices, strict=True):
            if len(at):
                part.train(hat[at], group, target, rng)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of (context, token) for both places, and log normalisers of (context, context)."""
        a = self.context @ self.place[0] @ self.target.T
        b = self.context @ self.place[1] @ self.target.T + self.bias
        top_a, top_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        z = np.log(np.exp(a - top_a) @ np.exp(b - top_b).T) + top_a + top_b.T
        return a, b, z


def _scatter(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add rows to the rows of ``to`` with the given numbers."""
    width = to.shape[1]
    to += np.bincount((at[:, None] * width + np.arange(width)).ravel(), weights=rows.ravel(), minlength=to.size).reshape(to.shape)


def contexts(ids: np.ndarray, starts: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each token; ``before`` where the text has none. starts: of the texts."""
    one = np.concatenate(([before], ids[:-1]))
    one[starts] = before
    two = np.concatenate(([before, before], ids[:-2]))[: len(ids)]
    two[starts] = before
    seconds = starts + 1
    two[seconds[seconds < len(ids)]] = before
    return one, two


def trained(docs: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """Train on all texts, each partition on its own, and average the copies by their tokens."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = pa.schema([("weight", pa.int64()), ("model", pa.binary())])

    def train(it):
        vocab = held.value
        model, rng, seen = LogBilinear(vocab.share, vocab), np.random.default_rng(3), 0
        memory = [np.full_like(p, 1e-6) for p in model.parameters()]

        def work(tokens, starts):
            nonlocal seen
            ids, inner = vocab.ids(tokens), vocab.choices(tokens)
            one, two = contexts(ids, np.array(starts), vocab.size)
            mixed = rng.permutation(len(ids))
            for k in range(0, len(ids), BATCH):
                p = mixed[k : k + BATCH]
                model.train(one[p], two[p], ids[p], rng, memory)
            for k in range(0, len(ids), 8 * BATCH):
                p = mixed[k : k + 8 * BATCH]
                model.train_inside(one[p], two[p], inner(ids, p), rng)
            seen += len(ids)

        for batch in it:
            tokens, starts = [], []
            for body in batch.column(0).to_pylist():
                starts.append(len(tokens))
                tokens += words(body or b"")
                tokens.append(END)
                if len(tokens) > 400_000:
                    work(tokens, starts)
                    tokens, starts = [], []
            if tokens:
                work(tokens, starts)
        if seen:
            yield from batches({"weight": [seen], "model": [pack((model.parameters(), [(x.vector.astype(np.float16), x.bias.astype(np.float16), x.seen) for x in model.inner]))]}, schema)

    def average(it):
        got = _average([(w, unpack(blob)) for frame in it for w, blob in zip(frame["weight"], frame["model"], strict=True)])
        if got:
            yield pd.DataFrame({"weight": [got[0]], "model": [pack(got[1])]})

    copies = docs.select(F.col("text").cast("binary")).mapInArrow(train, "weight long, model binary")
    copies = written(copies)
    while (held_now := copies.count()) > MERGED:  # a tree, as deep as the copies are many
        copies = written(copies.repartition(-(-held_now // MERGED)).mapInPandas(average, "weight long, model binary"))
    rows = copies.collect()  # at most MERGED models of fixed size
    model = LogBilinear(vocab.share, vocab)
    if got := _average([(r["weight"], unpack(r["model"])) for r in rows]):
        model.context, model.target, model.place, model.bias = (m.astype(np.float32) for m in got[1][0])
        for x, (vector, bias, seen) in zip(model.inner, got[1][1], strict=True):
            x.vector, x.bias = vector.astype(np.float32), np.where(seen > 0, bias, x.bias).astype(np.float32)
            x.memory = x.bias_memory = x.seen = None  # of use in training only
    return model


def _average(copies: list[tuple]) -> tuple | None:
    """The mean of (tokens, model) copies: of each matrix by tokens, of vectors inside classes by how often each was trained."""
    if not copies:
        return None
    total = sum(w for w, _ in copies)
    outer = [sum(np.asarray(p, np.float64) * (w / total) for p, (w, _) in zip(ps, copies, strict=True)).astype(np.float32) for ps in zip(*(m[0] for _, m in copies), strict=True)]
    inner = []
    for parts in zip(*(m[1] for _, m in copies), strict=True):
        seen = sum(x[2] for x in parts)
        by = np.maximum(seen, 1)
        inner.append((sum(x[0] * (x[2] / by)[:, None] for x in parts).astype(np.float16), sum(x[1] * (x[2] / by) for x in parts).astype(np.float16), seen))
    return total, (outer, inner)


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent tokens, at most HEAD of them, ordered by hash."""
    least = _floor(counts, HEAD)
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.filter(_bin() >= least)

    def hashed(it):
        for batch in it:
            t, c = rows_of(batch, "token", "c")
            h = np.array([xxhash.xxh3_64_intdigest(x) for x in t], dtype=np.uint64)
            yield from batches({"blob": [pack((h, np.array(c, dtype=np.int64)))]}, pa.schema([("blob", pa.binary())]))

    parts = [unpack(r[0]) for r in rows.mapInArrow(hashed, "blob binary").collect()]
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h)
    return h[order], c[order]


def scored(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear, total: int, types: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast((vocab, model, _head(counts)))
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64()), ("token", pa.binary()), ("n", pa.int64())])

    def block(base_uid, ids, bodies, state):
        vocab, (a, b, z), hashes, head_c, log_inside, inner, (near, far) = state
        number: dict[bytes, int] = {}
        rows, starts, n = [], [], 0
        for body in bodies:
            starts.append(n)
            row = [number.setdefault(t, len(number)) for t in words(body or b"")]
            row.append(number.setdefault(END, len(number)))
            rows.append(row)
            n += len(row)
        flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=n)
        distinct = list(number)
        h = np.array([xxhash.xxh3_64_intdigest(t) for t in distinct], dtype=np.uint64)
        at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
        found = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
        c = np.where(found, head_c[at], 0) if len(hashes) else np.zeros(len(h), np.int64)
        word_class = vocab.ids(distinct)
        log_c = np.log10(c + 1.0)
        ids_ = word_class[flat]
        one, two = contexts(ids_, np.array(starts), vocab.size)
        lm = (a[one, ids_] + b[two, ids_] - z[one, two]).astype(np.float64) / np.log(10)
        choices = vocab.choices(distinct)
        number = choices.number[flat]
        for part, (at_, group, target) in zip(inner, choices(word_class, flat), strict=True):
            lm[at_] += part.log_chances(near[one[at_]] + far[two[at_]], group, target).astype(np.float64) / np.log(10)
        rare_class = (vocab.inside[ids_] > 0) & (number < 0)
        lm -= np.where(rare_class, log_inside[ids_], 0)
        lm += np.where(rare_class, log_c[flat], 0)
        cut = np.array(starts)
        sums = [np.add.reduceat(x, cut) for x in (log_c[flat], lm, found[flat].astype(np.int64))]
        doc = np.repeat(np.arange(len(bodies)), np.diff([*starts, n]))
        rest = np.flatnonzero(~found[flat])
        keys, times = np.unique(doc[rest] * len(distinct) + flat[rest], return_counts=True)
        k, m = len(bodies), len(keys)
        out = {
            "uid": [*range(base_uid, base_uid + k), *(base_uid + keys // len(distinct)).tolist()], "doc_id": [*ids, *[None] * m], "n_tokens": [*(len(r) for r in rows), *[None] * m], "n_known": [*sums[2].tolist(), *[None] * m],
            "base": [*sums[0].tolist(), *[None] * m], "lm": [*sums[1].tolist(), *[None] * m], "token": [*[None] * k, *(distinct[j] for j in (keys % len(distinct)).tolist())], "n": [*[None] * k, *times.tolist()],
        }
        yield from batches(out, schema)

    def run(it):
        vocab, model, (hashes, head_c) = held.value
        state = vocab, model.tables(), hashes, head_c, np.log10(np.maximum(vocab.inside, 1)), model.inner, (model.context @ model.place[0], model.context @ model.place[1])
        uid = TaskContext.get().partitionId() << 36
        for batch in it:
            ids, bodies = rows_of(batch, "doc_id", "body")
            start, size = 0, 0
            for k, body in enumerate([*bodies, None]):
                if k > start and (k == len(bodies) or size > 4 << 20):
                    yield from block(uid, ids[start:k], bodies[start:k], state)
                    uid, start, size = uid + k - start, k, 0
                size += len(body or b"")

    mixed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base double, lm double, token binary, n long"))
    whole = mixed.filter("token is null").drop("token", "n")
    in_words = F.col("token").isin([bytearray(t) for t in vocab.number])
    rest = (
        mixed.filter("token is not null").select("uid", "token", "n").join(counts, "token")
        .groupBy("uid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_c"), F.sum(F.when(in_words, 0.0).otherwise(F.col("n") * F.log10(F.col("c") + 1))).alias("log_rare"))
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return whole.join(rest, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"),
        (F.col("base") + zero("log_c") - F.col("n_tokens") * F.log10(F.lit(float(total + types + 1)))).alias("base_score"), (F.col("lm") + zero("log_rare")).alias("score"),
    )


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score all texts with a model learned from those that ``train`` (a condition) lets through.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (unigram, add one) and score (the model), log10 of the
    whole text. A null or empty text is one end. Repeated rows count and are scored each; other columns are not read.
    Without training texts every token is unknown.
    """
    docs = docs.withColumns({"_train": train}).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "_train")
    known = docs.filter("_train")
    counts = counted(known)
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocab = vocabulary(counts, total)
    model = trained(known, vocab)
    return scored(docs, counts, vocab, model, total, types).withColumn("train_tokens", F.lit(total).cast("long"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose remainder by 7 is 2 are held out."""
    got = score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return got.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
