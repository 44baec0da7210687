"""Collocations against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from factweave.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, w1 string, words string, score double, rank long"


def brute(rows, least, swallow, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", folded):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= swallow * a for q, b in cand.items()):
                continue
            s, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((" ".join(p), a, l, r, total[lang], s))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, k + 1, *x) for k, x in enumerate(rows[:top])]
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "The", "the", "x\x01", "x", "x\x00", "é", "É", "東京"])
    sep = lambda: rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "!", "\x0b", "\x1c", " "])
    out = [("".join(word() + sep() for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und", ""])) for _ in range(n)]
    return out + [(None, "en"), (None, None), ("", "de"), ("...,,", "de"), ("the the the " * 3000, "en"), out[0], out[0], ("one", "zz")]


@pytest.mark.parametrize(("least", "swallow", "top", "segment"), [(5, 80, 2000, 4 << 20), (3, 60, 7, 500), (1, 100, 50, 20)])
def test_equals_brute_force(spark, monkeypatch, least, swallow, top, segment):
    monkeypatch.setattr(phrases, "SEGMENT", segment)
    monkeypatch.setattr(phrases, "HOT", 6)  # several hot words
    rows = texts(least)
    frame = spark.createDataFrame([(k, t, lang, 1, "w", "x", 0.5, 2) for k, (t, lang) in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in phrases.collocations(frame, least, swallow, top).collect())
    assert got == brute(rows, least, swallow, top)


def test_segments_overlap(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab .\t\n") for _ in range(rng.randrange(80))).encode()
        whole = [w for p, _ in phrases.tokens(text) for w in p.to_pylist()]
        for segment in (1, 3, 10):
            parts = [(p.to_pylist(), n) for p, n in phrases.tokens(text, segment)]
            assert [w for p, n in parts for w in p[:n]] == whole
            at = 0
            for p, n in parts:
                want = whole[at : at + len(p)]
                at += n
                ahead = whole[at : at + 3]
                ahead = ahead[: ahead.index(b".") + 1] if b"." in ahead else ahead
                assert p == want and p[n:] == ahead


def test_products_beyond_64_bits(spark):
    """Counts near 2**45 times 2,000,000 pass 64 bits; the division stays exact."""
    from pyspark.sql import functions as F

    a, l, r = 2**45 + 1, 2**45 + 7, 2**45 + 12345  # noqa: E741
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    assert row.select(F.expr(phrases.SCORE)).first()[0] == 2000000 * a // (l + r)


def test_empty(spark):
    out = phrases.collocations(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_one_long_word_and_long_piece():
    (found, own) = next(phrases.tokens(b"x" * 9_000_000 + b" y", 4 << 20))
    assert found.to_pylist() == [b"x" * 9_000_000, b"y"] and own == 1
