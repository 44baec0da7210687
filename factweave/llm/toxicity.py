"""Toxicity with a learned lexicon and fuzzy matching.

Words that toxic training texts use significantly more than clean ones make a lexicon with a weight for each term. The
lexicon is a trie; a word's Levenshtein automaton (bit-parallel, one error) runs along it, so misspelled terms match
too, with a weight of their own learned the same way. It also reads tokens with their digits and symbols inside, as in
"idi0t"; few of these are words, so they have a third weight, which starts at that of the term. A window around each
match tells quotation from abuse: marks that close in it, or an open mark and a word that clean texts use beside the terms.
Quoted matches have features, and so learned weights, of their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, rows_of, slices, table, tidy, written
from .langid import remainder

_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
REMEMBERED = 200_000
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
#: Words on each side that are looked at for quotation.
WINDOW = 12
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
#: Features of a text.
FEATURES = 9


class Trie:
    """The lexicon's terms; ``near`` runs a word's Levenshtein automaton along it.

    One error leaves one half of a term as it is. So the terms are held twice: by first half with a trie of the rest, and
    by second half with a trie of the rest backwards; the automaton runs only below halves that the word has.
    """

    def __init__(self, terms):
        self.front: dict[str, dict] = {}
        self.back: dict[str, dict] = {}
        for t in terms:
            if len(t) > 1:
                h = len(t) // 2
                for tries, half, rest in ((self.front, t[:h], t[h:]), (self.back, t[h:], t[h - 1 :: -1])):
                    node = tries.setdefault(half, {})
                    for c in rest:
                        node = node.setdefault(c, {})
                    node[""] = t
        self.heads, self.tails = (sorted({len(x) for x in tries}) for tries in (self.front, self.back))
        self.longest = max(map(len, terms), default=0)

    def near(self, word: str) -> set[str]:
        """Terms at one edit (insertion, deletion, substitution) from the word, which is none itself."""
        out: set[str] = set()
        if len(word) > self.longest + 1:  # more than one edit from any term
            return out
        for k in self.heads:
            if (root := self.front.get(word[:k])) is not None:
                self._walk(root, word[k:], out)
        for k in self.tails:
            if (root := self.back.get(word[-k:])) is not None:
                self._walk(root, word[-k - 1 :: -1] if len(word) > k else "", out)
        return out

    @staticmethod
    def _walk(root: dict, rest: str, out: set[str]) -> None:
        mask: dict[str, int] = {}
        for i, c in enumerate(rest):
            mask[c] = mask.get(c, 0) | 1 << i
        last = 1 << len(rest)
        stack = [(root, 1, 2)]  # states after i letters: bit i, without and with an error
        while stack:
            node, zero, one = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (zero | one) & last:
                        out.add(child)
                    continue
                m = mask.get(c, 0)
                z = (zero & m) << 1
                o = ((one & m) << 1) | zero | (zero << 1) | (z << 1)
                if z or o:
                    stack.append((child, z, o))


class Model:
    """Weights of the terms, exact, misspelled and broken by a digit or symbol, and of the features of a text's matches."""

    def __init__(self, exact: dict[str, float], fuzzy: dict[str, float], reports: frozenset, weights: list[float], broken: dict[str, float] | None = None):
        self.exact, self.fuzzy, self.reports, self.weights = exact, fuzzy, reports, weights
        self.broken = exact if broken is None else broken
        self.trie = Trie(exact)
        self.known: dict[str, tuple] = {}

    def match(self, token: str) -> tuple:
        """The lexicon terms in a token: (term, 0 exact, 1 misspelled or 2 broken) pairs."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            out = []
            runs = (token,) if token.isalpha() else _LETTERS.findall(token)
            for w in runs:
                if w in self.exact:
                    out.append((w, 0))
                else:
                    out += [(t, 1) for t in sorted(self.trie.near(w))]
            if runs and (whole := _ENDS.sub("", token)) not in runs:
                own = {t for t, kind in out if not kind}
                if found := self.trie.near(whole) - own:
                    out = [x for x in out if x[0] not in found] + [(t, 2) for t in sorted(found)]
            got = tuple(out)
            if len(token) <= 4 * self.trie.longest:
                self.known[token] = got
        return got

    def matches(self, text: str) -> list[tuple[int, str, int]]:
        """All matches of a text as (token number, term, kind)."""
        tokens = text.lower().split()
        hit = {t for t in set(tokens) if self.match(t)}
        return [(k, term, kind) for k, t in enumerate(tokens) if t in hit for term, kind in self.match(t)] if hit else []

    def in_quotes(self, tokens: list[str], k: int) -> bool:
        """Whether quotation marks, or a reporting word before a mark, surround token k within the window."""
        before, after = tokens[max(0, k - WINDOW) : k + 1], tokens[k : k + WINDOW + 1]
        opened = 0
        for t in before:
            for c in t:
                if c == '"':
                    opened = 1 - opened
                elif c in _OPEN:
                    opened = 1
                elif c in _CLOSE:
                    opened = 0
        if not (opened or tokens[k][0] in _OPEN):
            return False
        closes = any(any(c in _CLOSE for c in t[1 if j == 0 else 0 :]) for j, t in enumerate(after))
        return closes or any(_ENDS.sub("", t) in self.reports for t in before)

    def context(self, text: str) -> set[str]:
        """The words beside exact terms, within the window."""
        tokens, out = text.lower().split(), set()
        for k, _, kind in self.matches(text):
            if not kind:
                out.update(_ENDS.sub("", t) for t in tokens[max(0, k - WINDOW) : k])
        return out

    def features(self, text: str | None, found: list | None = None) -> list[float]:
        """1, then of the matches: log-odds of the strongest term and of the noisy-or of all terms, how many there are, exact
        and misspelled, how dense they are, how many strong terms; of the quoted ones log-odds and how many there are. A broken match counts by its weight."""
        found = (self.matches(text) if text else []) if found is None else found
        if not found:
            return [1.0] + [0.0] * (FEATURES - 1)
        tokens = text.lower().split()
        marks = any(c in text for c in _OPEN)
        best: tuple[dict[str, float], dict[str, float]] = ({}, {})
        counts, quoted = [0.0, 0.0], 0.0
        for k, term, kind in found:
            p = (self.exact, self.fuzzy, self.broken)[kind][term]
            own = 1.0 if kind < 2 else p / self.exact[term]
            if inside := marks and self.in_quotes(tokens, k):
                quoted += own
            else:
                counts[kind % 2] += own
            best[inside][term] = max(best[inside].get(term, 0.0), p)
        odds = [math.log(max(p, 1e-3) / max(1 - p, 1e-3)) + 7 for p in (max(best[0].values(), default=0.0), 1 - math.prod(1 - p for p in best[0].values()), 1 - math.prod(1 - p for p in best[1].values()))]
        strong = sum(p for p in best[0].values() if p > 0.5)
        return [1.0, odds[0], odds[1], math.log1p(counts[0]), math.log1p(counts[1]), math.log1p(1000 * sum(counts) / len(tokens)), math.log1p(strong), odds[2], math.log1p(quoted)]

    def score(self, text: str | None, found: list | None = None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text, found), strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> list[float]:
    """Weights of a logistic regression, by Newton steps with a ridge on all but the first."""
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, train, sample: int = 20_000, terms: int = 5000, least_g: float = 30.0, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from at most ``sample`` labelled documents that ``train`` (a condition on doc_id) lets through.

    Which ones is decided by a hash of doc_id. A term needs a log-likelihood ratio of ``least_g`` and more toxic than
    clean texts after scaling; the lexicon holds the ``terms`` with the highest ratios at most, and as many words beside
    them that clean texts favour. Null labels do not count; of repeated labels of a document the highest does.
    """
    named = labels.filter(train & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("y"))
    picked = named.orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(sample)
    texts = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("text", F.col("y").cast("int").alias("y")))
    schema = pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def counting(words):
        def count(it):
            got = (Counter(), Counter())
            for batch in it:
                for t, y in zip(*rows_of(batch, "text", "y"), strict=True):
                    got[y > 0].update({*words(t), ""})
            keys = list(got[0].keys() | got[1].keys())
            yield from batches({"term": keys, "pos": [got[1][k] for k in keys], "neg": [got[0][k] for k in keys]}, schema)

        return texts.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    stats = counting(lambda t: (w for x in t.lower().split() for w in _LETTERS.findall(x)))
    whole = stats.filter(F.col("term") == "").first()
    if not whole or not whole["pos"] or not whole["neg"]:
        always = bool(whole and whole["pos"])
        return Model({}, {}, frozenset(), [20.0 if always else -20.0] + [0.0] * (FEATURES - 1))
    n1, n0 = whole["pos"], whole["neg"]

    def telling(stats: DataFrame, n1: int, n0: int, toxic: bool) -> list:
        """The terms whose counts differ most, among those that toxic, or else clean, texts favour."""
        both = F.col("pos") + F.col("neg")
        part = lambda k, n: F.when(k > 0, 2 * k * F.log(k * F.lit(float(n1 + n0)) / (both * n))).otherwise(0.0)
        more = F.col("pos") * n0 - F.col("neg") * n1
        rows = stats.filter((F.length("term") >= 3) & (F.col("pos" if toxic else "neg") >= 3) & ((more > 0) if toxic else (more < 0)))
        return rows.withColumn("g", part(F.col("pos"), n1) + part(F.col("neg"), n0)).filter(F.col("g") >= least_g).orderBy(F.desc("g"), "term").limit(terms).collect()

    chosen = telling(stats, n1, n0, True)
    exact = {r["term"]: (r["pos"] + 0.5) / (r["pos"] + r["neg"] + 1.0) for r in chosen}
    draft = Model(exact, dict.fromkeys(exact, 0.0), frozenset(), [0.0] * FEATURES)
    held = docs.sparkSession.sparkContext.broadcast(draft)

    def marks(t: str):
        found = held.value.matches(t)
        if all(kind for _, _, kind in found):  # a text with an exact term says nothing on misspellings
            yield from {f"{kind}{term}" for _, term, kind in found}
        else:
            yield "0"
            yield from (f"0{w}" for w in held.value.context(t))

    marked = written(counting(marks))
    seen = {r["term"]: (r["pos"], r["neg"]) for r in marked.filter("term = '0' or substring(term, 1, 1) in ('1', '2')").collect()}  # of each term
    beside = marked.filter("term like '0_%'").withColumn("term", F.expr("substring(term, 2)"))
    reports = frozenset(r["term"] for r in telling(beside, *seen["0"], False)) if "0" in seen else frozenset()
    fuzzy, broken = {}, {}
    for t in exact:
        a, b = seen.get(f"1{t}", (0, 0))
        fuzzy[t] = (a + 0.75) / (a + b + 1.0)
        a, b = seen.get(f"2{t}", (0, 0))
        broken[t] = (a + exact[t]) / (a + b + 1.0)
    full = Model(exact, fuzzy, reports, [0.0] * FEATURES, broken)
    ready = docs.sparkSession.sparkContext.broadcast(full)

    def measured(it):
        for batch in it:
            t, y = rows_of(batch, "text", "y")
            yield from batches({"x": [ready.value.features(v) for v in t], "y": y}, pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())]))

    rows = texts.mapInArrow(measured, "x array<double>, y int").collect()  # at most ``sample`` rows of FEATURES numbers
    full.weights = _logistic(np.array([r["x"] for r in rows]), np.array([float(r["y"] > 0) for r in rows]))
    return full


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and hits (matched terms) of every row; a null or empty text has no hits and the score of texts without any.

    Repeated rows each get their row; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most ``terms`` terms
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.list_(pa.string()))])

    def run(it):
        m = held.value
        for batch in slices(it, 1):
            ids, texts = rows_of(batch, "doc_id", "text")
            found = [m.matches(t) if t else [] for t in texts]
            yield from batches({"doc_id": ids, "score": [m.score(t, f) for t, f in zip(texts, found, strict=True)], "hits": [sorted({x for _, x, _ in f}) for f in found]}, schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, hits array<string>")


def clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score under ``least``, with all their columns; null texts stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(it):
        m = held.value
        for batch in slices(it, column):
            (texts,) = rows_of(batch, "text")
            yield batch.filter(pa.array([m.score(t) < least for t in texts], type=pa.bool_()))
        m.known.clear()  # the broadcast model outlives the task
        tidy()

    return docs.mapInArrow(run, docs.schema)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the query and the pipeline: rows whose remainder by 5 is 0 stay unseen."""
    return fit(docs, labels, remainder("doc_id", 5) != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = table(spark, sf_dir, "documents")
    got = scores(docs, learned(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
