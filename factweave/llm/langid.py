"""Language identification of mixed text.

A word ends where its script changes. The script narrows the candidate languages, character n-grams score the word for
each of them, in pieces where it is long as in scripts without spaces, and a Viterbi pass with a penalty for switching labels spans of one language. The document takes the language of most of its words.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mix, rows_of, slices, table

#: First code points of script ranges and the scripts that begin there (fixed values; letters outside are "other").
SCRIPTS = [
    (0x0041, "latin"), (0x0250, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3005, "han"), (0x3008, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "other"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x31350, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_MUL, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000
#: Letters of a piece of a word. N-grams that begin in a piece are scored there and reach into the next.
PIECE = 40
#: A word or piece speaks at most so much (in nats) for or against a language.
MOST = 12.0
#: Letters whose n-grams are summed at once, but at least a word.
BLOCK = 1 << 17
#: Bytes of texts whose words are worked out together, but at least a text.
TOGETHER = 2 << 20


def script_of(letter: str) -> str:
    k = bisect.bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPTS[k][1] if k >= 0 else "other"


def grams(word: str) -> list[str]:
    """The word with marked ends, and its character 2- to 4-grams."""
    return [g for piece in pieces(word) for g in piece]


def pieces(word: str):
    """The grams of a word, for each PIECE of its letters; every one comes once."""
    s = f"\x02{word}\x03"
    n, whole = len(s), ["\x04" + word]
    cuts = [0, *range(PIECE + 1, n - 1, PIECE), n]
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        yield [*whole, *(s[i : i + k] for k in (2, 3, 4) for i in range(a, min(b, n - k + 1)))]
        whole = []


def runs(text: str):
    """(script, run) of the runs of letters of one script."""
    for word in (text,) if text.isalpha() else _LETTERS.findall(text):
        if word.isascii():
            yield "latin", word
        else:
            for script, letters in itertools.groupby(word, script_of):
                yield script, "".join(letters)


def _scripts() -> np.ndarray:
    """For each code point the number of its script in SCRIPT_NAMES, -1 where it is no letter."""
    starts = np.array(_STARTS)
    out = np.full(0x110000, -1, np.int8)
    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    letter = np.zeros(len(codes), bool)
    for m in _LETTERS.finditer("".join(map(chr, codes))):
        letter[m.start() : m.end()] = True
    codes = np.array(codes)[letter]
    number = np.array([SCRIPT_NAMES.index("other"), *(SCRIPT_NAMES.index(s) for _, s in SCRIPTS)], np.int8)
    out[codes] = number[np.searchsorted(starts, codes, side="right")]
    return out


def _hashed(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k letters that follow each other."""
    h = codes[: len(codes) - k + 1].astype(np.uint64) + np.uint64(k)
    for j in range(1, k):
        h = h * _MUL + codes[j : len(codes) - k + 1 + j]
    return mix(h)


def _whole(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of whole words, by where they begin and their lengths."""
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(first, size).astype(np.uint64)
    return mix(np.add.reduceat(mix(codes * _MUL + place * _MUL2), first) + np.uint64(4)) if len(first) else np.zeros(0, np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Model:
    """Per-language n-gram log-probabilities and the scripts each language uses."""

    def __init__(self, langs: list[str], counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray], penalty: float):
        self.langs, self.penalty = langs, penalty
        size = len(langs)
        total = np.zeros(size)
        for v in counts.values():
            total += v
        add = 0.1
        base = np.log(total + add * (len(counts) + 1)) if size else total
        keys = np.zeros(len(counts), np.uint64)
        for k, g in enumerate(counts):
            c = _codes(g)
            keys[k] = _whole(c[1:], np.zeros(1, np.int64), np.array([len(c) - 1]))[0] if g[0] == "\x04" else _hashed(c, len(c))[0]
        order = np.argsort(keys)
        scores = np.log(np.array(list(counts.values())).reshape(-1, size) + add) - base if counts else np.zeros((0, size))
        self.keys = np.concatenate((keys[order], np.zeros(1, np.uint64)))
        self.scores = np.concatenate((scores[order], np.zeros((1, size)))).astype(np.float32)  # the last row is that of unknown n-grams
        self.bits = max(1, int(len(counts)).bit_length() + 1)
        self.first = np.searchsorted(keys[order] >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1)).astype(np.int32)
        share = {s: v / max(v.sum(), 1) for s, v in scripts.items()}
        allowed = np.zeros((len(SCRIPT_NAMES), max(size, 1)))  # a script that no language learned has speaks for none
        self.learned = np.zeros(len(SCRIPT_NAMES), bool)
        for name, v in share.items():
            allowed[SCRIPT_NAMES.index(name)] = np.where(v > 0.001, 0.0, -MOST)
            self.learned[SCRIPT_NAMES.index(name)] = True
        self.allowed = allowed.astype(np.float32)
        self.script = None
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, max(size, 1)), dtype=np.float32)
        self.weight = np.zeros(1024, dtype=np.int32)

    def gram(self, h: np.ndarray) -> np.ndarray:
        """Rows of n-grams by their hashes."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), len(self.keys) - 1, np.int32)
        more = np.flatnonzero(at < end)
        while len(more):
            k = at[more]
            hit = self.keys[k] == h[more]
            out[more[hit]] = k[hit]
            more = more[~hit]
            at[more] += 1
            more = more[at[more] < end[more]]
        return out

    def learn(self, tokens) -> None:
        """Work out the rows of all tokens that are not known yet."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [t for t in tokens if t not in known]
        if not new:
            return
        if self.script is None:
            self.script = _scripts()
        start = len(known)
        known.update(zip(new, range(start, start + len(new)), strict=True))
        while start + len(new) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.weight = np.concatenate((self.weight, np.zeros_like(self.weight)))
        self.rows[start : start + len(new)] = 0
        self.weight[start : start + len(new)] = 0
        at, held = 0, 0
        for k, t in enumerate(new):
            held += len(t) + 1
            if held > BLOCK or k + 1 == len(new):
                self._add(start + at, new[at : k + 1])
                at, held = k + 1, 0

    def _add(self, base: int, words: list[str]) -> None:
        """Add what the pieces of words say to their rows, from ``base`` on."""
        codes = _codes(" ".join(words))
        script = self.script[codes]
        letter = script >= 0
        before = np.concatenate(([-1], script[:-1]))
        first = np.flatnonzero(letter & (script != before))
        if not len(first):
            return
        after = np.concatenate((script[1:], [-1]))
        size = np.flatnonzero(letter & (script != after)) + 1 - first
        of = base + np.cumsum(codes == 32)[first]
        kind = script[first]
        whole = _whole(codes[letter], np.cumsum(size) - size, size)
        marked = np.zeros(int(size.sum()) + 2 * len(size), np.uint64)  # each run with marked ends
        begin = np.cumsum(size + 2) - size - 2
        marked[begin], marked[begin + size + 1] = 2, 3
        marked[np.repeat(begin + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = codes[letter]
        run = np.repeat(np.arange(len(size)), size + 2)
        piece = np.maximum((np.arange(len(marked)) - begin[run] - 1) // PIECE, 0)
        several = np.maximum((size - 1) // PIECE, 0) + 1
        number = (np.cumsum(several) - several)[run] + np.minimum(piece, several[run] - 1)
        sums = np.zeros((int(several.sum()), self.scores.shape[1]))
        parts = [(whole, np.cumsum(several) - several)]
        for k in (2, 3, 4):
            inside = np.flatnonzero(run[: len(run) - k + 1] == run[k - 1 :])
            parts.append((_hashed(marked, k)[inside], number[inside]))
        h, to = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = self.gram(h)
        ok = (row < len(self.keys) - 1) & self.learned[kind][run[begin]][np.repeat(np.arange(len(size)), several)][to]
        row, to = row[ok], to[ok]
        for j in range(sums.shape[1]):
            sums[:, j] = np.bincount(to, weights=self.scores[row, j], minlength=len(sums))
        owner = np.repeat(np.arange(len(size)), several)
        sums = np.clip(sums - sums.max(axis=1, keepdims=True), -MOST, 0) / 2 + self.allowed[kind[owner]]  # overlapping n-grams tell less than independent ones
        np.add.at(self.rows, of[owner], sums.astype(np.float32))
        np.add.at(self.weight, of[owner], 1)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word, each switch costing the penalty."""
        n, size = scores.shape
        best = int(scores.sum(axis=0).argmax())
        gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum.accumulate(np.concatenate((np.zeros((1, size)), gain[:-1])), axis=0)
        if 2 * (gain - low).max() <= self.penalty:  # k stretches gain at most what their k - 1 switches cost: the path is constant
            return np.full(n, best)
        back = np.empty((n, size), dtype=np.int16)
        own = list(range(size))
        d = [0.0] * size
        pen = self.penalty
        for t, row in enumerate(scores.tolist()):
            top = max(own, key=d.__getitem__)
            limit = d[top] - pen
            for k in own:
                if d[k] < limit:
                    d[k], back[t, k] = limit + row[k], top
                else:
                    d[k], back[t, k] = d[k] + row[k], k
        out = np.empty(n, dtype=np.int64)
        k = max(own, key=d.__getitem__)
        for t in range(n - 1, -1, -1):
            out[t] = k
            k = int(back[t, k])
        return out

    def label(self, ids: np.ndarray, spans: bool = True) -> tuple[str, float, list[tuple[int, int, str]] | None]:
        """The language of a text, by the rows of its tokens, a confidence from 0 to 1, and its spans as (first token, end token, language)."""
        n = self.weight[ids]
        if not n.any() or not self.langs:
            return "und", 0.0, []
        scores = self.rows[ids]
        path = self.path(scores)
        share = np.bincount(path, weights=n, minlength=len(self.langs))
        best = int(share.argmax())
        inside = scores[path == best].sum(axis=0)
        rest = np.delete(inside, best)
        margin = float(inside[best] - rest.max()) if len(rest) else 50.0
        score = float(share[best] / share.sum() / (1 + math.exp(-min(max(margin, -50), 50))))
        if not spans:
            return self.langs[best], score, None
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return self.langs[best], score, [(a, b, self.langs[path[a]]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def labels(self, texts: pa.Array, spans: bool = True):
        """What ``label`` says of each text of a block, whose words are worked out together."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        flat = lists.flatten()
        real = np.asarray(pc.binary_length(flat)) > 0
        cuts = np.concatenate(([0], np.cumsum(real)))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        rows = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        ids = rows[np.asarray(coded.indices)] if distinct else np.zeros(0, np.int64)
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            yield self.label(ids[a:b], spans)


def fit(docs: DataFrame, train, sample: int = 8000, least: int = 2, features: int = 200_000, penalty: float = 12.0, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from at most ``sample`` documents with a language among those that ``train`` (a condition) lets through.

    Which ones is decided by a hash of doc_id; the bound holds for the driver and the model at any size of input. The
    model holds the ``features`` most frequent n-grams of these documents, by total count, and none under ``least``.
    """
    picked = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id), F.lit(7)).alias("_o"))
    cut = [r[0] for r in picked.select("_o").orderBy("_o").limit(sample).agg(F.max("_o")).collect()][0]
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def count(it):
        got: dict[str, Counter] = {}
        for batch in it:
            for t, l in zip(*rows_of(batch, "text", "lang"), strict=True):
                words = Counter(w for x in t.lower().split() for w in runs(x))
                to = got.setdefault(l, Counter())
                for (script, w), k in words.items():
                    for piece in pieces(w):
                        to[f"\x05{script}"] += k
                        for g in piece:
                            to[g] += k
        for l, c in got.items():
            yield from batches({"lang": [l] * len(c), "gram": list(c), "n": list(c.values())}, schema)

    if cut is None:
        return Model([], {}, {}, penalty)
    counted = picked.filter(F.col("_o") <= cut).select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
    rows = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")).groupBy("gram").agg(F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    rows = rows.filter((F.col("t") >= least) | F.col("gram").startswith("\x05")).orderBy(F.desc("t"), "gram").limit(features).collect()
    langs = sorted({l for r in rows for l in r["by"]})
    vector = {r["gram"]: np.array([r["by"].get(l, 0) for l in langs], dtype=np.float64) for r in rows}
    scripts = {g[1:]: v for g, v in vector.items() if g[0] == "\x05"}
    per_lang = np.sum(list(scripts.values()), axis=0) if scripts else np.ones(len(langs))
    return Model(langs, {g: v for g, v in vector.items() if g[0] != "\x05"}, {s: v / np.maximum(per_lang, 1) for s, v in scripts.items()}, penalty)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, and if asked for spans (structs of start, end and lang, over white-space tokens), of every row.

    A text that is null, empty or without letters is ``und`` with score 0 and no spans; so is every text if nothing
    could be learned. Repeated rows each get their row; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` n-grams
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), *([("spans", pa.list_(span))] if spans else [])])

    def run(it):
        m = held.value
        for batch in slices(it, 1, TOGETHER):
            lang, score, found = zip(*m.labels(batch.column(1), spans), strict=True)
            got = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if spans:
                got.append(pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in f] for f in found], type=schema.field("spans").type))
            yield pa.RecordBatch.from_arrays(got, schema=schema)

    more = ", spans array<struct<start: int, end: int, lang: string>>" if spans else ""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, lang_pred string, score double{more}")


def remainder(doc_id, n: int):
    """crc32 of a doc_id as text (null: empty), modulo n."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, remainder("doc_id", 4) != 2)
    return predict(docs, model, spans=False).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
