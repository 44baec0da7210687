"""Shape analysis: assignment cases by hand and against concrete heaps, calls, and path partitions against brute force."""

import itertools
import random

from factweave.operators import shape

CONFIG = "n int, target string, value string, counts map<string, int>, radius array<string>, hits array<string>, misses array<string>"

#: target = value on (counts, radius, hits, misses): the configurations after it.
CASES = [
    ("t", "x", ({}, "yz", [], []), [({}, "yz", [], [])]),
    ("t", "x", ({}, "x", [], []), [({}, "tx", [], [])]),
    ("t", "x", ({"n": 1}, "t", [], []), [({"n": 1}, "", [], [])]),
    ("t", "x", ({"n": 1}, "ty", [], []), [({"n": 1}, "y", [], [])]),
    ("x", "t.n", ({}, "xt", [], []), [({}, "t", [], [])]),
    ("x", "t.n", ({"n": 1}, "", [], []), [({"n": 1}, "", [], ["t.n"]), ({"n": 1}, "x", ["t.n"], [])]),
    ("x", "t.n", ({"n": 1}, "y", [], []), [({"n": 1}, "y", [], ["t.n"]), ({"n": 1}, "xy", ["t.n"], [])]),
    ("t.n", "x", ({}, "x", [], []), [({"n": 1}, "x", ["t.n"], [])]),
    ("t.n", None, ({"n": 1}, "", ["t.n"], []), []),  # nothing refers to it any longer
    ("t.n", None, ({"n": 1}, "", [], []), [({"n": 1}, "", [], ["t.n"])]),
    ("t.n", None, ({"n": 3}, "", [], []), [({"n": 2}, "", [], ["t.n"]), ({"n": 3}, "", [], ["t.n"]), ({"n": 3}, "", [], ["t.n"])]),
    ("t.n", "x", ({"n": 2}, "x", ["y.n"], ["t.n"]), [({"n": 3}, "x", ["t.n", "y.n"], [])]),
    ("x", "x", ({"n": 1}, "x", ["x.n"], []), [({"n": 1}, "x", ["x.n"], [])]),
    ("y", "x", ({"n": 1}, "", ["x.n"], ["y.n"]), [({"n": 1}, "", ["x.n", "y.n"], [])]),
]


def show(rows):
    return sorted((sorted(dict(r[0]).items()), "".join(sorted(r[1])), sorted(r[2]), sorted(r[3])) for r in rows)


def test_assignment_cases(spark):
    rows = [(k, t, v, c, list(r), h, m) for k, (t, v, (c, r, h, m), _) in enumerate(CASES)]
    out = shape.assign(spark.createDataFrame(rows, CONFIG), "target", "value").collect()
    for k, (t, v, before, after) in enumerate(CASES):
        assert show([(r.counts, r.radius, r.hits, r.misses) for r in out if r.n == k]) == show(after), (t, v, before)


def described(heap, local, obj):
    """An object's configuration in a concrete heap, with all that is true of paths of one field."""
    counts = {}
    for (_, f), to in heap.items():
        if to == obj:
            counts[f] = min(counts.get(f, 0) + 1, shape.MANY)
    paths = {f"{x}.{f}": local[x] is not None and heap.get((local[x], f)) == obj for x in local for f in "fg"}
    return counts, {x for x, o in local.items() if o == obj}, {p for p, yes in paths.items() if yes}, {p for p, yes in paths.items() if not yes}


def test_assignments_cover_concrete_heaps(spark):
    """Of each object of a random heap, the configuration after the assignment is among those derived from a part of what is known before."""
    rng = random.Random(6)
    rows, truth = [], []
    for _ in range(400):
        objs = range(4)
        heap = {(o, f): rng.choice([None, *objs]) for o in objs for f in "fg"}
        local = {x: rng.choice([None, *objs, *objs]) for x in "xyz"}
        path = lambda: rng.choice("xyz") + rng.choice(["", ".f", ".g"])
        target, value = path(), rng.choice([path(), path(), None])
        get = lambda p, heap=heap, local=local: None if p is None or local[p[0]] is None else local[p] if len(p) == 1 else heap.get((local[p[0]], p[2]))
        if len(target) > 1 and (local[target[0]] is None or value and len(value) > 1) or value and len(value) > 1 and local[value[0]] is None:
            continue  # no such store, and stores are from locals
        new_heap, new_local = dict(heap), dict(local)
        if len(target) == 1:
            new_local[target] = get(value)
        else:
            new_heap[local[target[0]], target[2]] = get(value)
        for o in objs:
            counts, radius, hits, misses = described(heap, local, o)
            if counts or radius:
                known = lambda s: [p for p in s if rng.random() < 0.5]
                rows.append((len(rows), target, value, counts, sorted(radius), known(hits), known(misses)))
                truth.append(described(new_heap, new_local, o))
    out = {}
    for r in shape.assign(spark.createDataFrame(rows, CONFIG), "target", "value").collect():
        out.setdefault(r.n, []).append(r)
    for n, (counts, radius, hits, misses) in enumerate(truth):
        if counts or radius:
            fits = [r for r in out.get(n, []) if dict(r.counts) == counts and set(r.radius) == radius and set(r.hits) <= hits and set(r.misses) <= misses]
            assert fits, (rows[n], counts, radius)


def test_split_and_merge(spark):
    rng = random.Random(3)
    slots = ["f", "g", "h"]
    rows = [(k, k % 4, {s: rng.randrange(1, 4) for s in rng.sample(slots, rng.randrange(4))}, sorted(rng.sample("abcd", rng.randrange(5)))) for k in range(200)]
    states = spark.createDataFrame(rows, "state int, call int, counts map<string, int>, radius array<string>")
    visible = spark.createDataFrame([(c, s) for c in range(3) for s in rng.sample([*slots, *"abcd"], 3)], "call int, slot string")
    local, remote = shape.split(states, visible)
    keys = remote.collect()
    assert len({(r.call, r.key) for r in keys}) == len(keys) < 120  # many states share one
    back = {r.state: (r.call, dict(r.counts), list(r.radius)) for r in shape.merge(local, remote).collect()}
    assert back == {k: (c, m, r) for k, c, m, r in rows}
    doubled = remote.unionByName(remote)  # two outcomes of each call
    assert shape.merge(local, doubled).count() == 400 and shape.merge(local, remote.filter("false")).count() == 0


def partition(rng, names, n):
    return {p: rng.randrange(n) for p in names if rng.random() < 0.9}


def test_meet_intersects_partitions(spark):
    rng = random.Random(8)
    names = ["x", "y", "x.f", "y.f", "z", "z.g"]
    paths, points, want = [], [], set()
    for point in range(40):
        states = []
        for k in range(rng.randrange(1, 4)):
            part = partition(rng, names, 3)
            hits = {p: rng.choice([True, False, None]) for p in part}
            states.append((part, hits))
            points += [(point, 10 * point + k)] * 2
            paths += [(10 * point + k, p, f"c{c}", hits[p]) for p, c in part.items()]
        common = [p for p in names if all(p in s for s, _ in states)]
        for p in common:
            mates = [q for q in common if all(s[p] == s[q] for s, _ in states)]
            values = {h[p] for _, h in states}
            want.add((point, min(mates), p, values.pop() if len(values) == 1 else None))
    got = shape.meet(spark.createDataFrame(paths, "state int, path string, class string, hit boolean"), spark.createDataFrame(points, "point int, state int"))
    assert {tuple(r) for r in got.collect()} == want


def test_unified_is_congruent(spark):
    rng = random.Random(9)
    names = ["x", "y", "z", "x.f", "y.f", "z.f", "x.f.g", "y.f.g"]
    paths, equal, want = [], [], {}
    for state in range(25):
        cls = {p: {p} for p in names}
        pairs = [tuple(rng.sample(names, 2)) for _ in range(rng.randrange(3))]
        equal += [(state, a, b) for a, b in pairs]
        hits = {p: rng.choice([None, None, True]) for p in names}
        paths += [(state, p, p, hits[p]) for p in names]
        join = lambda a, b, cls=cls: [cls.__setitem__(p, cls[a] | cls[b]) for p in cls[a] | cls[b]] if b not in cls[a] else []
        while any([*(join(a, b) for a, b in pairs), *(join(f"{a}.{f}", f"{b}.{f}") for a, b in itertools.combinations(names, 2) for f in "fg" if b in cls[a] and f"{a}.{f}" in cls and f"{b}.{f}" in cls)]):
            pass
        want |= {(state, p): (min(cls[p]), True if any(hits[q] for q in cls[p]) else None) for p in names}
    got = shape.unified(spark.createDataFrame(paths, "state int, path string, class string, hit boolean"), spark.createDataFrame(equal, "state int, a string, b string"))
    assert {(r.state, r.path): (r["class"], r.hit) for r in got.collect()} == want
    left = shape.forgotten(got, spark.createDataFrame([(0, "x")], "state int, root string"))
    assert {r.path for r in left.filter("state = 0").collect()} == {p for p in names if p[0] != "x"}
