"""Cases of the second review: wrapped pages, long tokens, long repetitive texts, maximal repeats."""

import random
import resource
import time

import numpy as np

from factweave.llm import htmltext, jaccard, quality, toxicity

LONG = "Some words that go on and on, with commas, for quite a while. " * 4

#: (page, main text).
PAGES = [
    ("<body><form id=f><div class='content'><h1>Title</h1><p>Some words, that go on for a while here.</p></div></form></body>", "Title\nSome words, that go on for a while here."),
    (f"<body><form action=x><input name=q><div><p>{LONG}</p><p>Short end</p></div></form></body>", f"{LONG.strip()}\nShort end"),
    (f"<body><article><p>{LONG}</p></article><form><label>Mail</label><input><p>Send it to us</p></form></body>", LONG.strip()),
    (f"<body><div id=w><div><p>{LONG}</p></div><div><p>{LONG}</p></div><div>Last short line</div></div></body>", f"{LONG.strip()}\n{LONG.strip()}\nLast short line"),
    (f"<body><article><div><p>{LONG}</p></div><div>Last short line</div></article><footer>foot</footer></body>", f"{LONG.strip()}\nLast short line"),
    (f"<body><div class=post><div>First</div><div><p>{LONG}</p></div></div><div><a href=x>a link</a></div></body>", f"First\n{LONG.strip()}"),
    (f"<body><main><section><p>{LONG}</p></section><section><p>{LONG}</p></section></main><div class=sidebar>side</div></body>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<body><div class=comments><p>{LONG}</p></div><article><p>{LONG}</p></article></body>", LONG.strip()),
    ("<body><form><select><option>one</select><input></form></body>", ""),
    (f"<form><form><p>{LONG}", LONG.strip()),
]


def test_pages():
    for page, text in PAGES:
        assert htmltext.main_text(page) == text, page


def test_long_tokens_take_linear_time():
    model = toxicity.Model({"idiot": 1.0, "scum": 1.0}, {"idiot": 0.5, "scum": 0.5}, frozenset(), [0.0] * toxicity.FEATURES)
    began = time.process_time()
    token = "idi" + "o" * 5_000_000
    assert model.matches(f"a {token} idiott b {token}") == [(2, "idiot", 1)]
    assert not model.trie.near("scu" + "m" * 5_000_000) and time.process_time() - began < 10
    assert token not in model.known


def _brute(d, least):
    n, rep = len(d), [0] * len(d)
    for i in range(n):
        for j in range(n):
            size = 0
            while i != j and max(i, j) + size < n and d[i + size] == d[j + size]:
                size += 1
            rep[i] = max(rep[i], size)
    covered = lambda m, span: len({p for i in range(n) if rep[i] >= m for p in range(i, i + span(rep[i]))})
    most = max(rep, default=0)
    return covered(least, lambda r: r), most, covered(3, lambda r: 3)


def _maximal(d):
    out = set()
    for v in range(2, len(d)):
        for w in {tuple(d[i : i + v]) for i in range(len(d) - v + 1)}:
            at = [i for i in range(len(d) - v + 1) if tuple(d[i : i + v]) == w]
            if len(at) > 1 and len({d[i - 1] if i else None for i in at}) > 1 and len({d[i + v] if i + v < len(d) else None for i in at}) > 1:
                out.add(w)
    return out


def test_repetition_and_maximal_repeats():
    rng = random.Random(1)
    for _ in range(150):
        docs = [[rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 5))]
        got = quality.repetition([np.array(d, dtype=np.int64) for d in docs], 5)
        assert [tuple(int(x[k]) for x in got) for k in range(len(docs))] == [_brute(d, 5) for d in docs]
        if d := docs[0]:
            code, begins = np.array(d, dtype=np.int64), np.arange(len(d)) == 0
            order, shared = quality.suffix_order(code, np.full(len(d), len(d)))
            size, first, last = quality.intervals(quality.common_prefix(code, order, shared), 2)
            kept = quality.maximal(code, begins, order, first, last)
            assert {tuple(d[order[x] : order[x] + v]) for v, x in zip(size[kept], first[kept], strict=True)} == _maximal(d)


def test_long_repetitive_text_has_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = 3_000_000
    assert [int(x[0]) for x in quality.repetition([np.zeros(n, np.int64)], 8)] == [n, n - 1, n]
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / n < 0.3  # KB a word


def test_shingles_with_one_short_number_count_each():
    doc = np.array([0, 0, 0, 1, 1, 1, 2, 2, 3])
    short = np.array([7, 7, 9, 7, 7, 7, 7, 9, 7], np.uint32)
    got = jaccard._apart(doc, short)
    sets = [set(got[doc == k].tolist()) for k in range(4)]
    assert [len(s) for s in sets] == [3, 3, 2, 1] and len(sets[0] & sets[1]) == 2 and sets[2] <= sets[0] and sets[3] <= sets[1]


def test_links_at_the_bound_with_few_short_numbers(spark, monkeypatch):
    """All shingles have one of few short numbers, and still no link at exactly three quarters is lost."""
    rng = random.Random(2)
    apart = jaccard._apart
    monkeypatch.setattr(jaccard, "_apart", lambda doc, short: apart(doc, short % np.uint32(3)))
    rows, want = [], {}
    for k in range(12):
        words = [f"w{k}_{j}" for j in range(4 * 7 + 4)]  # 28 shingles; 4 changed at the end leave 24 of 32
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-4], *(f"x{rng.random()}" for _ in range(4))]))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame).collect()} == want
