"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factweave.llm import bpe, decontaminate, htmltext, jaccard, langid, lm, quality, shard, suffixdup, toxicity

SCHEMA = "doc_id long, text string, lang string, body string, h long, db int, _new string, label string, `_h` long"


def words(rng, n, most=40):
    return " ".join(f"{rng.choice('abcdefg')}{rng.randrange(most)}" for _ in range(n))


def texts():
    rng = random.Random(3)
    base = words(rng, 120)
    passage = words(rng, 60, 900)
    near = base.split()
    near[50] = "changed"
    out = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "One  TWO"), (9, words(rng, 5000)),
        (10, "x " * 400), (11, words(rng, 30) + " " + passage + " " + words(rng, 30)), (12, words(rng, 50) + " " + passage), (13, "é東京 " * 60), (None, words(rng, 80)), (None, None), (15, passage + "\n" + passage),
        (16, base + " tail"), (16, words(rng, 70)),
    ]
    return out + [(20 + k, words(rng, rng.randrange(1, 90))) for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "b", 1, 2, "n", "l", 3) for i, t in texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted(rows, key=repr)




def test_suffix_dedup(spark, docs, empty, monkeypatch):
    rows = [(i, t) for i, t in texts() if i not in (None, 16)]  # one text for each id
    frame = docs.filter("doc_id is not null and doc_id <> 16")
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest(), kept)
    for common in (10_000, 1):  # also the way of very common cores
        monkeypatch.setattr(suffixdup, "COMMON", common)
        got = suffixdup.repeats(frame).drop("spans").collect()
        assert key(tuple(r) for r in got) == key((i, *want[i][:4]) for i, _ in rows)
    cleaned = suffixdup.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    by_id = {r.doc_id: r.text for r in cleaned.filter("doc_id < 9").collect()}
    assert by_id[3].encode() == want[3][4] and by_id[4] is None and by_id[5] == ""
    assert suffixdup.repeats(empty).count() == 0


def test_jaccard(docs, empty):
    rows = texts()
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    nodes = list(sets)
    label = {i: i for i in nodes}
    least = lambda x: -(1 << 63) if x is None else x
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[a] != label[b] and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                    label[a] = label[b] = min(label[a], label[b], key=least)
                    changed = True
    want = [(i, len(s), label[i]) for i in sets for s in sets[i]]
    got = [tuple(r) for r in jaccard.near_duplicates(docs).collect()]
    assert key(got) == key(want)
    kept = jaccard.clean(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in nodes if i is None or label[i] == i}
    assert jaccard.near_duplicates(empty).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(texts()[11][1].split()[40:70])), (2, "one two"), (3, None), (4, "!!"), (5, "never seen anywhere")], "item_id long, text string")

    def parts(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in t or "").split(" ")

    windows = {}
    for i, t in ((r.item_id, r.text) for r in bench.collect()):
        w = [x for x in parts(t) if x]
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in texts():
        w = [x for x in parts(t) if x]
        hit, items = set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= names
        want.append((i, len(w), len(hit), ",".join(sorted(items))))
    for block in (1 << 20, 1):  # also several blocks of benchmark items
        got = decontaminate.scan(docs, bench, block_bytes=block).collect()
        flat = [(r.doc_id, r.n_words, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)), ",".join(r["items"])) for r in got]
        assert key(flat) == key(want)
        kept = decontaminate.clean(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and kept.count() == sum(1 for w in want if not w[2])
    assert {r.text for r in decontaminate.clean(docs, bench, mode="spans", block_bytes=block).filter("doc_id = 7").collect()} == {""}
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0


def test_bpe(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", "  a", "a  b", " a b ", "a\n b", "it's  I'll\n\n x", "<|endoftext|> hi<|endoftext|>", "é 東京 ½² x　y", "0\x00\x01 emoji 😀😀  !!", " 's x'S", "aaaaaaaaaaaaaaaaaaaa" * 20]
    coder = bpe.bpe_of(bpe.vocabulary())
    import numpy as np

    for t in odd + [t or "" for _, t in texts()]:
        ids = np.frombuffer(coder.encode(t), dtype="<u4")
        assert ids.tolist() == known.encode(t, add_special_tokens=False).ids
        assert coder.decode(ids.astype(np.int64)) == known.decode(ids.tolist(), skip_special_tokens=False) == t
    assert coder.decode(np.array([447], dtype=np.int64)) == known.decode([447], skip_special_tokens=False)  # a part of a letter
    back = bpe.decode(bpe.encode(docs)).collect()
    assert key((r.doc_id, r.text) for r in back) == key((i, t or "") for i, t in texts())
    assert bpe.digest(empty).count() == 0


def test_quality(docs, empty):
    want = {}
    for i, t in texts():
        w = (t or "").encode().split()
        three = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        covered, longest = set(), 0
        for a in range(len(w) if len(w) < 400 else 0):
            for b in range(a):
                n = 0
                while a + n < len(w) and w[a + n] == w[b + n]:
                    n += 1
                longest = max(longest, n)
                if n >= 8:
                    covered |= set(range(a, a + n)) | set(range(b, b + n))
        lines = [x for x in (t or "").encode().split(b"\n") if x.strip()]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        kept = not failed and len(covered) <= 0.3 * len(w) and longest <= 50
        want.setdefault((i, len(w)), (len(inside), len(lines) - len(set(lines)), failed, kept if len(w) < 400 else None, longest if len(w) < 400 else None))
    for r in quality.rules(docs).collect():
        inside, dup, failed, kept, longest = want[r.doc_id, r.n_words]
        assert (r.n_repeat_words, r.n_dup_lines, r.base_failed) == (inside, dup, failed)
        if kept is not None:
            assert (r.kept, r.longest_repeat) == (kept, longest)
    assert quality.rules(docs).filter("doc_id = 13").first().word_chars == 180
    assert quality.rules(empty).count() == 0


def test_shards(docs, empty):
    rows = shard.shard(docs, 4).collect()
    assert len(rows) == len(texts())
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    size = collections.Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert sum(size.values()) == sum(len((t or "").encode()) + 8 for _, t in texts())
    assert max(size.values()) <= sum(size.values()) / 4 + max(r["size"] for r in rows)
    assert {r.text_crc32 for r in rows if r.doc_id == 1} == {zlib.crc32(texts()[0][1].encode())}
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1 and shard.shard(empty).count() == 0


def test_language(spark, empty):
    rng = random.Random(1)
    stems = {"aa": ["ba", "lo", "mi", "nek"], "bb": ["schu", "rött", "gan", "ält"], "ru": ["при", "вет", "мо", "ска"]}
    say = lambda l, n: " ".join("".join(rng.choice(stems[l]) for _ in range(3)) for _ in range(n))
    rows = [(k, say(l, 30), l) for k, l in enumerate(["aa", "bb", "ru"] * 40)]
    odd = [(900, None, None), (901, "123 !!", "aa"), (902, say("aa", 20) + " " + say("bb", 60), "bb"), (903, say("ru", 3), None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(frame, langid.remainder("doc_id", 4) != 2)
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert all(got[k].lang_pred == l for k, _, l in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "bb" and got[903].lang_pred == "ru"
    assert [s.lang for s in got[902].spans] == ["aa", "bb"] and got[902].spans[0].end in (19, 20, 21)
    assert langid.fit(empty, F.lit(True)).langs == [] and langid.predict(empty, model).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(2)
    rows = [(k, words(rng, 40, 30) + (" you blighter scoundrel" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    odd = [(900, None), (901, ""), (902, "you blighterr " + words(rng, 20, 30)), (903, "You BLIGHTER!"), (904, words(rng, 30, 30))]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    model = toxicity.learned(frame, labels)
    got = {r.doc_id: r.score for r in toxicity.scores(frame, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert got[902] > got[904] and got[903] >= 0.5 and got[900] == got[901] < 0.5
    plain, quoted = model.score("he is a blighter and more"), model.score('she said "he is a blighter" and more')
    assert quoted < plain
    assert toxicity.clean(frame, model).count() == sum(1 for v in got.values() if v < 0.5)
    assert toxicity.scores(empty, toxicity.learned(empty, labels)).count() == 0


def test_fuzzy_terms():
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    terms = {word(5, 9) for _ in range(200)}
    trie = toxicity.Trie(terms)

    def one(a, b):
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a != b and (a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :])

    for _ in range(2000):
        w = word(3, 10)
        assert w in terms or trie.near(w) == {t for t in terms if one(w, t)}


def test_language_model(docs, empty):
    train = langid.remainder("doc_id", 7) != 2
    name = lambda i: "" if i is None else str(i)
    counts = collections.Counter()
    for i, t in texts():
        if zlib.crc32(name(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in texts():
        w = [*(t or "").encode().lower().split(), b"\n"]
        want.append((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    rows = lm.score(docs, train).collect()
    assert key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == key(want)
    assert all(r.score < 0 for r in rows)
    import numpy as np

    model = lm.LogBilinear(np.full(20, 0.05))
    a, b, z = model.tables()
    p = np.exp(a[3][None, :] + b - z[3][:, None])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert lm.score(empty, train).count() == 0


def test_language_model_beats_counts(spark):
    """On held-out texts of the larger table the model gives more than smoothed counts, also when copies are merged in a tree."""
    got = lm.op2_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_hot_text_is_cut_over_shards(spark):
    rows = [(k, "the same text again") for k in range(300)] + [(1000 + k, f"other {k} " * (k % 7)) for k in range(300)] + [(None, None), (5, "the same text again")]
    got = shard.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    total = collections.Counter()
    for r in got:
        total[r.shard] += r["size"]
    assert len(got) == len(rows) and max(total.values()) - sum(total.values()) / 5 <= max(r["size"] for r in got)
    hot = collections.Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"the same text again"))
    assert len(hot) >= 3  # half of all bytes


def test_html_pages_of_any_depth_and_damage():
    assert htmltext.main_text("<p>Alpha beta gamma.</p><p class=\"x") == "Alpha beta gamma."
    assert htmltext.main_text("a < b and c<d> e </> f &lt;") == "a < b and c e f <"
    page = "<div id='main' class='has-sidebar'><div class='content with-sidebar'><div class='entry-header'><h1>T</h1></div><p>One, two, three, four and more.</p><h2>S</h2><ul><li>x<li>y</ul><p>Five, six, seven.</p></div><div class='sidebar'><p>No, no, no, no, no, no.</p></div></div><div class='comments'><p>" + "Long, comment, " * 60 + "</p></div>"
    assert htmltext.main_text(page) == "T\nOne, two, three, four and more.\nS\nx\ny\nFive, six, seven."
    for part in ('<a "', "<div>", '<a b="', "<", "<script>", "</p", "<!--", "<p class=x "):
        htmltext.main_text(part * 20_000)  # each ends soon
    assert htmltext.main_text("<div>" * 50_000 + "<p>deep, far down.</p>") == "deep, far down."


def test_equal_windows():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        t = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(150, 1500))).astype(np.uint8)
        t = np.concatenate((t, t[: len(t) // 2]))
        length = int(rng.choice([9, 40, 100, 128]))
        start = np.arange(len(t) - length + 1)
        got, body, seen = suffixdup.equal_windows(t, start, length), t.tobytes(), {}
        want = [seen.setdefault(body[i : i + length], len(seen)) for i in start]
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(seen)


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls, empty texts, repeated rows, other columns with clashing names, and an empty table."""
    import corpus_pipeline

    rng = random.Random(12)
    long = words(rng, 200, 900)
    rows = [(1, long), (1, long), (2, long + " tail"), (3, None), (None, words(rng, 80)), (None, None), (4, ""), (5, words(rng, 60, 900)), (6, "one two")]
    frame = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], "doc_id long, text string, lang string, h long, _found_0 long")
    labels = spark.createDataFrame([(1, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "never seen here at all"), (2, None)], "item_id long, text string")
    for name, docs in (("full", frame), ("empty", frame.limit(0))):
        sf = f"{tmp_path}/{name}"
        for t, f in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            f.write.parquet(f"{sf}/{t}.parquet")
        at = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, sf)
            assert at.columns == frame.columns
        got = corpus_pipeline.run(spark, sf)
        kept = sorted((r.doc_id for r in got.collect()), key=repr)
        assert kept == (sorted([1, 3, None, None, 4, 5, 6], key=repr) if name == "full" else [])


def test_html():
    page = "<html><head><title>t</title><script>var a='<p>no';</script></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy, now, this.</div><article><h1>A &amp; B</h1><p>First,  one,\n two.<p><b>Second<br>line</b></p><ul><li>x</li></ul><form><input>no</form></article><div id=comments><p>I, too, say, so, much, here.</p></div><footer>&copy; no</footer></body></html>"
    assert htmltext.main_text(page) == "A & B\nFirst, one, two.\nSecond line\nx"
    assert [htmltext.main_text(x) for x in (None, "", "plain", "<div><div>", "<p>a<p>b")] == ["", "", "plain", "", "a\nb"]
    assert htmltext.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hello, you.</p>"), (2, None, None), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    assert key(tuple(r) for r in htmltext.extract(pages).collect()) == key([(1, "u", "Hello, you.", 11), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)])


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "bpe"]
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < docs.count() and out.count() == out.select("doc_id").distinct().count()
