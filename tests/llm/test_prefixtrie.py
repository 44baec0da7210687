"""The prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from factweave.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, ids string, words long, n long, depth int, bucket string"


def brute(convs):
    """Nodes of conversations {conv: [(role, text), ...]}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^ \t-\r]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()),
        key=repr,
    )


def told(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest())
    return {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in convs.items()}


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 400), n):
        depth = rng.choice([1, 2, 3, 5, 9])
        for t in range(depth):
            rows.append((c, t, rng.choice(["user", None]) if t > 4 else "user", rng.choice(["hi", "hi there", "ok\tfine\n x"]) if t else rng.choice(["hi", "hi", "hello you"])))
    long = [(1000 + k, t, "user", "hi" if t < 150 else f"w{t} {k}") for k in range(3) for t in range(200)]
    copies = [(2000 + k, t, "bot", f"same {t}") for k in range(40) for t in range(30)]
    odd = [(7000, None, None, None), (7000, 1, "", ""), (None, 1, "user", "lost"), (7001, 5, "a", "b"), (7001, 5, "a", "b"), (7001, 5, "a", "a"), (7002, 1, "user", "é 東京\x0bx")]
    return [(*r, "i", 1, 2, 3, "b") for r in rows + long + copies + odd]


@pytest.mark.parametrize(("seed", "local"), [(1, 1 << 16), (2, 50), (3, 1)])
def test_equals_brute_force(spark, seed, local):
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in prefixtrie.nodes(prefixtrie.encode(frame), local).collect()), key=repr)
    assert got == brute(told(rows))


def test_rebuilt_conversations(spark, tmp_path):
    rows = conversations(9, 200)
    own = told(rows)
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        root = c - (c % 20 if c >= 0 else -(-c % 20))
        convs[c] = own.get(root, [])[:h] + turns[h:]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    frame = prefixtrie.op11_prefix_trie(spark, str(tmp_path))
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == brute(convs)


def test_parts_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PART", 7)  # many parts a group
    rows = [(c, 0, "u", "x" if c % 3 else "y") for c in range(300)] + [(999, 0, "u", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = sorted((tuple(r) for r in prefixtrie.nodes(prefixtrie.encode(frame)).collect()), key=repr)
    assert got == brute({c: [(r, t)] for c, _, r, t in rows})


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.nodes(prefixtrie.encode(frame)).count() == 0
    assert prefixtrie.nodes(prefixtrie.encode(spark.createDataFrame([(None, 1, "u", "t", "", 1, 1, 1, "")], SCHEMA))).count() == 0


def test_long_text_and_one_turn(spark):
    frame = spark.createDataFrame([(5, 1, "u", "word " * 1_000_000)], "conv_id long, turn int, role string, text string")
    got = sorted((tuple(r)[:7] for r in prefixtrie.nodes(prefixtrie.encode(frame)).collect()), key=lambda r: r[1])
    assert got == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]
