"""Cases of the first review."""

import itertools
import random

import numpy as np

from factweave.llm import jaccard, langid, toxicity

DOC = "doc_id long, text string, `_id` long, h map<string,int>"


def words(rng, n, most=900):
    return " ".join(f"{rng.choice('abcdefg')}{rng.randrange(most)}" for _ in range(n))


def test_clean_keeps_one_row_of_each_component(spark):
    rng = random.Random(5)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(None, a), (1, a), (2, a + " tail"), (3, a), (4, b), (4, b), (5, b + " tail"), (None, c), (None, c), (None, d), (7, e), (7, e.upper()), (8, ""), (8, ""), (None, None)]
    frame = spark.createDataFrame([(i, t, k, {"k": k}) for k, (i, t) in enumerate(rows)], DOC)
    out = jaccard.clean(frame)
    kept = out.collect()
    assert out.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(None, a), (4, b), (None, c), (None, d), (7, e.upper()), (8, ""), (8, ""), (None, None)], key=repr)
    assert all(r.h == {"k": r._id} and rows[r._id] == (r.doc_id, r.text) for r in kept)


def test_broken_and_short_terms(spark):
    rng = random.Random(6)
    one = lambda k: (" scum idiot" if k % 10 == 0 else "") + (" vermin" if k % 10 == 0 and k % 40 or k % 8 == 1 else "")
    frame = spark.createDataFrame([(k, words(rng, 30, 30) + one(k)) for k in range(800)], "doc_id long, text string")
    model = toxicity.learned(frame, spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(800)], "doc_id long, toxic int"))
    assert {"scum", "idiot", "vermin"} <= set(model.exact) and model.exact["vermin"] < 0.5  # likelier in toxic texts, which are few
    for w, t in (("idi0t", "idiot"), ("id*ot", "idiot"), ("(1diot!)", "idiot"), ("sc_um", "scum"), ("sc0m.", "scum"), ("scumm", "scum"), ("skum", "scum")):
        assert {x for _, x, _ in model.matches(f"a {w} b")} == {t}, w
    rest = words(rng, 10, 30)
    assert all(model.score(f"{rest} you {w}") >= 0.5 for w in ("idi0t", "id*ot", "sc_um")) and model.score(f"{rest} 10:30 a/b") < 0.5
    assert not model.matches("a c.d 123 ___ x-y")


def test_short_terms_are_near():
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choice("abcd") for _ in range(rng.randint(a, b)))
    terms = {word(2, 4) for _ in range(40)}
    trie = toxicity.Trie(terms)
    edits = lambda w: {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in ["", *"abcd"] for j in (i, i + 1) if j <= len(w)}
    for _ in range(1000):
        w = word(1, 5)
        assert w in terms or trie.near(w) == terms & edits(w)


def test_language_reads_whole_runs(spark):
    rng = random.Random(8)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    zh, zz, ja = "的一是不了人我在有他", "這個們中來上大為和國", "のはをがにでとしたる"
    rows = [(3 * k + j, say(letters, 200), lang) for k in range(40) for j, (letters, lang) in enumerate([(zh, "zh"), (zz, "zz"), (ja, "ja")])]
    rows += [(500 + k, " ".join(say("abcde", 5) for _ in range(20)), "en") for k in range(40)]
    odd = [(900, say(zh, 40) + say(zz, 400), None), (901, "abc" + say(ja, 300), None), (902, say(zz, 1 << 17) + say(zh, 1 << 18), None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(frame, langid.fit(frame, langid.remainder("doc_id", 4) != 2)).collect()}
    assert all(got[k] == lang for k, _, lang in rows) and (got[900], got[901], got[902]) == ("zz", "ja", "zh")


def test_every_gram_of_a_word_comes_once():
    for n in (1, 2, 39, 40, 41, 42, 79, 80, 81, 82, 200):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        s = f"\x02{word}\x03"
        want = ["\x04" + word, *(s[i : i + k] for k in (2, 3, 4) for i in range(len(s) - k + 1))]
        assert sorted(langid.grams(word)) == sorted(want)
        assert max(map(len, langid.pieces(word))) <= 3 * (langid.PIECE + 2)
    assert list(langid.runs("abc社のx,人々")) == [("latin", "abc"), ("han", "社"), ("kana", "の"), ("latin", "x"), ("han", "人々")]


def test_best_path_of_short_mixed_texts():
    model = langid.Model(["a", "b", "c"], {}, {}, 12.0)
    assert model.path(np.array([[10.8, -50, 0], [-50, 10.8, 0]])).tolist() == [0, 1]
    rng = np.random.default_rng(9)
    for _ in range(300):
        scores = rng.normal(0, 6, (5, 3))
        value = lambda p, s=scores: s[range(5), list(p)].sum() - 12 * np.count_nonzero(np.diff(p))
        assert np.isclose(value(model.path(scores)), max(map(value, itertools.product(range(3), repeat=5))))
