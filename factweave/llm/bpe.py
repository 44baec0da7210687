"""Byte-pair encoding with a backtracking encoder, and decoding with an offset table.

The encoder takes the longest vocabulary match at each place from an Aho-Corasick automaton, holds it against the token
before with a pair-compatibility table (would merging in rank order join the two differently?), and goes back to the
next shorter match where the pair is impossible. This gives the merges' exact result in linear time.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, rows_of, table

#: The pieces between which no merge happens (fixed value of this kind of vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces, and words, that a worker remembers; a memory is emptied when full.
REMEMBERED = 250_000
#: Between two words: a lone space, which always begins a piece. Texts with other spaces are cut into pieces as a whole.
_OTHER_SPACE = re.compile(r"^ | $| \s|\s ")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file's encoder and decoder. Inside, a token's number is its merge rank, the 256 bytes first."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = byte_letters()
        vocab = model["model"]["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        names = [c for c, _ in sorted(letters.items(), key=lambda x: x[1])] + ["".join(m) for m in merges]
        number = {s: i for i, s in enumerate(names)}
        self.token_id = [vocab[s] for s in names]
        self.id_bytes = [i.to_bytes(4, "little") for i in self.token_id]
        self.length = [len(s) for s in names]
        self.split = [(i, i) for i in range(256)] + [(number[a], number[b]) for a, b in merges]
        self.pair = {p: 256 + i for i, p in enumerate(self.split[256:])}
        self.automaton = ahocorasick.Automaton()
        body = [raw(s).decode("latin-1") for s in names]
        for i, s in enumerate(body):
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        known = {s: i for i, s in enumerate(body)}
        self.shorter = [next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1) for s in body]
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        by_id = {vocab[s]: raw(s) for s in names} | {i: s.encode() for s, i in self.special.items()}
        size = max(by_id) + 1
        lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.store = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.fits: dict[int, bool] = {}
        self.pieces = regex.compile(PIECES).findall
        self.known = _Known(self.piece)
        self.spaced = _Known(lambda word: b"".join(map(self.known.__getitem__, self.pieces(" " + word))))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging in rank order can leave tokens a and b side by side."""
        key = a << 32 | b
        if (got := self.fits.get(key)) is None:
            if len(self.fits) >= 2 * REMEMBERED:
                self.fits.clear()
            got = self.fits[key] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 62  # merges below it happen before those that made the two tokens
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            left = a > b  # undo the later merge, at the side that touches the border
            for side in (left, not left):
                if side:
                    limit, a = a, self.split[a][1]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 != limit:
                        break
            else:
                return True

    def piece(self, piece: str) -> bytes:
        """The ids of one piece."""
        return b"".join([self.id_bytes[t] for t in self.tokens(piece.encode().decode("latin-1"))])

    def tokens(self, s: str) -> list[int]:
        """The tokens of one piece, given as one letter for each byte."""
        out: list[int] = []
        fits, at, token, last = self.fits.get, 0, -1, -1
        for end, token in self.automaton.iter_long(s):
            if last >= 0 and not (ok := fits(last << 32 | token)) and (ok is False or not self.compatible(last, token)):
                break
            out.append(token)
            at, last = end + 1, token
        else:
            return out
        dead: set[int] = set()
        while at < len(s):
            end = at + self.length[token]
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < len(s):
                    token = next(self.automaton.iter_long(s, at))[1]  # the longest that starts here
            elif (short := self.shorter[token]) >= 0:
                token = short
            else:
                dead.add(at)
                token = out.pop()
                at -= self.length[token]
        return out

    def _cut(self, text: str) -> bytes:
        if not text or _OTHER_SPACE.search(text):
            return b"".join(map(self.known.__getitem__, self.pieces(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.known.__getitem__, self.pieces(first)), *map(self.spaced.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers; special tokens' strings are special tokens."""
        if not self.special_at or not self.special_at.search(text):
            return self._cut(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._cut(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._cut(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: each token's bytes are gathered through the offset table."""
        start = self.offset[ids]
        length = self.offset[ids + 1] - start
        ends = np.cumsum(length)
        at = np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.store[at].tobytes().decode("utf-8", "replace")


class _Known(dict):
    """Encoded strings, worked out when first asked for."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> bytes:
        got = self.work(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = got
        return got


_made: dict[int, Bpe] = {}


def bpe_of(spec: str) -> Bpe:
    """One encoder for each worker process and vocabulary."""
    key = hash(spec)
    if key not in _made:
        _made[key] = Bpe(spec)
    return _made[key]


def vocabulary(path: str | None = None) -> str:
    """The text of a vocabulary file; by default the installed byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; a null or empty text has no ids. Other columns are not read."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # a vocabulary file, not data
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it):
        bpe = bpe_of(spec.value)
        for batch in it:
            ids, texts = rows_of(batch, "doc_id", "text")
            yield from batches({"doc_id": ids, "ids": [np.frombuffer(bpe.encode(t or ""), dtype="<i4") for t in texts]}, schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids count as none."""
    spec = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(it):
        bpe = bpe_of(spec.value)
        for batch in it:
            ids, tokens = rows_of(batch, "doc_id", "ids")
            yield from batches({"doc_id": ids, "text": [bpe.decode(np.array(t or [], dtype=np.int64)) for t in tokens]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, after encoding and decoding its whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(it):
        bpe = bpe_of(spec.value)
        for batch in it:
            ids, texts = rows_of(batch, "doc_id", "text")
            got = {f.name: [] for f in schema}
            for i, t in zip(ids, texts, strict=True):
                packed = bpe.encode(t or "")
                back = bpe.decode(np.frombuffer(packed, dtype="<u4").astype(np.int64))
                for name, v in zip(schema.names, (i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), strict=True):
                    got[name].append(v)
            yield from batches(got, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of its text decoded again."""
    return digest(table(spark, sf_dir, "documents"))
