"""Winnowing against brute force."""

import hashlib
import random
import zlib

from factweave.llm import winnow

SCHEMA = "doc_id long, text string, key string, at int, parts int, prints string, fingerprint long"


def brute(text):
    b = text.encode()
    if not b:
        return []
    g = [zlib.crc32(b[i : i + winnow.GRAM]) for i in range(max(1, len(b) - winnow.GRAM + 1))]
    chosen = set()
    for s in range(max(1, len(g) - winnow.WINDOW + 1)):
        window = range(s, min(s + winnow.WINDOW, len(g)))
        least = min(g[i] for i in window)
        chosen.add(max(i for i in window if g[i] == least))
    return [(g[i], i + 1) for i in sorted(chosen)]


def told(found):
    return " ".join(f"{h:x}@{p}" for h, p in found)


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "beta", "é", "東京", "gamma ", "x"])
    say = lambda n: " ".join(word() + str(rng.randrange(50)) for _ in range(n))
    fixed = [None, "", "a", "ab", "abc", "a" * 15, "a" * 16, "a" * 47, "a" * 48, "b" * 5000, "ab" * 900, "東" * 700, say(4000)]
    sizes = [winnow.CHUNK * m + d for m in (1, 2, 3) for d in range(46, 50)]
    return fixed + [say(400)[:n] for n in sizes] + [say(rng.randrange(1, 300)) for _ in range(80)]


def test_fingerprints(spark):
    rows = [(k, t, "k", 1, 2, "p", 3) for k, t in enumerate(texts())]
    got = {r.doc_id: r for r in winnow.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, t, *_ in rows:
        want = brute(t or "")
        assert got[k].fingerprint == told(want)
        assert [(v >> 31, v & (1 << 31) - 1) for v in got[k].prints] == want


def test_shared_stretches_are_found(spark):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [say(winnow.GRAM + winnow.WINDOW - 1) for _ in range(40)]
    rows = [(2 * k + side, say(rng.randrange(900)) + s + say(rng.randrange(900))) for k, s in enumerate(shared) for side in (0, 1)]
    got = {r.doc_id: {v >> 31 for v in r.prints} for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] & got[2 * k + 1] for k in range(40))


def expected(rows):
    """rows in descending order of ids."""
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), told(brute(t)), told(brute(new)), like(brute(t), brute(new)), like(brute(t), brute(after))))
    return out


def test_edited(spark):
    rows = [(k * 7 - 40, t) for k, t in enumerate(texts())]
    frame = spark.createDataFrame([(i, t, "k", 1, 2, "p", 3) for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in winnow.edited(frame).collect()), reverse=True)
    assert got == expected(rows[::-1])


def test_ties_nulls_and_few_rows(spark):
    one = spark.createDataFrame([(5, "abcdefghi")], "doc_id long, text string")
    assert [tuple(r) for r in winnow.edited(one).collect()] == expected([(5, "abcdefghi")])
    assert winnow.edited(one.filter("doc_id < 0")).count() == 0
    same = spark.createDataFrame([(None, "x" * 60), (None, None), (7, "y" * 30), (7, "y" * 30), (7, "y" * 30), (9, "z" * 90)], "doc_id long, text string")
    got = winnow.edited(same).collect()
    assert len(got) == 6 and sorted(r.n_chars for r in got) == [0, 30, 30, 30, 60, 90]
    nine = next(r for r in got if r.doc_id == 9)
    assert nine.edited_sha256 == hashlib.sha256(b"z" * 60 + b"y" * 30).hexdigest()
    assert sum(r.near_next == 1 for r in got if r.doc_id == 7) == 2  # the next of a repeated row is its copy


def test_ranges_meet(spark):
    rows = [(k, "") for k in range(2000)]
    got = {r.doc_id: r.next_text for r in winnow.followed(spark.createDataFrame([(i, f"t{i}") for i, _ in rows], "doc_id long, text string"), 30).collect()}
    assert got == {i: f"t{(i - 1) % 2000}" for i in range(2000)}


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = winnow.edited(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
