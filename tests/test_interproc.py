"""Call-graph growth, summaries and the store graph against brute force on random facts."""

import random

from factweave.operators import interproc, storegraph


def program(seed, n=7):
    """Random functions with two parameters, a result, locals, references and calls, with cycles."""
    rng = random.Random(seed)
    fns = [f"f{k}" for k in range(n)]
    flows, refs, calls, direct, actuals, formals = [], [], [], [], [], []
    for f in fns:
        slots = [f"{f}.{x}" for x in ("p", "q", "r", "a", "b")]
        formals += [(f, 0, slots[0]), (f, 1, slots[1]), (f, -1, slots[2])]
        flows += [(f, *rng.sample(slots, 2)) for _ in range(rng.randrange(1, 4))]
        refs += [(f, rng.choice(slots), rng.choice(fns)) for _ in range(rng.randrange(2))]
        for k in range(rng.randrange(1, 3)):
            site = f"{f}/{k}"
            calls.append((f, site, rng.choice(slots)))
            direct.append((f, site, rng.choice(fns)))
            actuals += [(site, p, rng.choice(slots)) for p in (0, 1, -1) if rng.random() < 0.8]
    return fns, flows, refs, calls, direct, actuals, formals


def frames(spark, flows, refs, calls, direct, actuals, formals):
    make = spark.createDataFrame
    return (
        make(flows, "fn string, src string, dst string"), make(refs, "fn string, slot string, target string"), make(calls, "fn string, site string, slot string"),
        make(direct, "fn string, site string, target string"), make(actuals, "site string, pos int, slot string"), make(formals, "fn string, pos int, slot string"),
    )


def test_top_down(spark):
    for seed in range(2):
        fns, flows, refs, calls, direct, actuals, formals = program(seed)
        live, held, edges = {"f0"}, set(), set()
        while True:
            before = len(live), len(held), len(edges)
            held |= {(s, t) for f, s, t in refs if f in live}
            copies = {(s, d) for f, s, d in flows if f in live}
            for f, site, g in edges:
                for s1, p, given in actuals:
                    copies |= {((given, own) if p >= 0 else (own, given)) for h, q, own in formals if s1 == site and h == g and q == p}
            held |= {(d, t) for s, d in copies for x, t in held if x == s}
            edges |= {(f, site, t) for f, site, s in calls if f in live for x, t in held if x == s}
            live |= {g for _, _, g in edges}
            if before == (len(live), len(held), len(edges)):
                break
        a = frames(spark, flows, refs, calls, direct, actuals, formals)
        got, found = interproc.top_down(a[0], a[1], a[2], a[4], a[5], spark.createDataFrame([("f0",)], "fn string"))
        assert {tuple(r) for r in got.collect()} == held and {tuple(r) for r in found.collect()} == edges


def inlined(fn, depth, facts, memo):
    """Pairs of formals that values pass between when calls are inlined to a depth."""
    if (fn, depth) in memo:
        return memo[fn, depth]
    _, flows, _, _, direct, actuals, formals = facts
    edges = {(s, d) for f, s, d in flows if f == fn}
    if depth:
        for f, site, g in direct:
            if f == fn:
                at = {p: s for x, p, s in reversed(actuals) if x == site}
                edges |= {(at[i], at[o]) for i, o in inlined(g, depth - 1, facts, memo) if i in at and o in at}
    own = {p: s for f, p, s in formals if f == fn}
    out = set()
    for i, s in own.items():
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            new = {d for a, d in edges if a == x} - seen
            seen |= new
            todo += new
        out |= {(i, o) for o, t in own.items() if t in seen and o != i}
    memo[fn, depth] = out
    return out


def test_summaries_equal_inlining(spark):
    for seed in range(2):
        facts = program(100 + seed)
        fns, flows, refs, calls, direct, actuals, formals = facts
        memo = {}
        want = {(f, i, o) for f in fns for i, o in inlined(f, 45, facts, memo)}  # 6 pairs a function: no more rounds than that bring anything new
        a = frames(spark, flows, refs, calls, direct, actuals, formals)
        assert {tuple(r) for r in interproc.summaries(a[0], a[3], a[4], a[5]).collect()} == want


def test_store_graph(spark):
    make = spark.createDataFrame
    merges = 0
    for seed in range(3):
        rng = random.Random(seed)
        v = lambda: f"v{rng.randrange(14)}"  # noqa: E731, B023
        allocs = [(v(), f"o{k:02}") for k in range(9)]
        copies = [(v(), v()) for _ in range(5)]
        loads, stores = ([(v(), rng.choice("fg"), v()) for _ in range(6)] for _ in range(2))
        region = {o: o for _, o in allocs}
        held = {}
        while True:
            held = {}
            for s, o in allocs:
                held.setdefault(s, set()).add(o)
            while True:  # inclusion with the regions so far, from the start
                size = sum(map(len, held.values()))
                edges = set(copies)
                for b, f, d in loads:
                    edges |= {(f"@{region[o]}.{f}", d) for o in held.get(b, ())}
                for b, f, s in stores:
                    edges |= {(s, f"@{region[o]}.{f}") for o in held.get(b, ())}
                for s, d in edges:
                    held.setdefault(d, set()).update(held.get(s, set()))
                if size == sum(map(len, held.values())):
                    break
            new = dict(region)
            changed = True
            while changed:
                changed = False
                for objs in held.values():
                    group = {o for o in new if new[o] in {new[x] for x in objs}}
                    least = min((new[o] for o in group), default=None)
                    for o in group:
                        changed |= new[o] != least
                        new[o] = least
            merges += new != region
            if new == region:
                break
            region = new
        got, regions = storegraph.solve(make(allocs, "slot string, obj string"), make(copies, "src string, dst string"), make(loads, "base string, field string, dst string"), make(stores, "base string, field string, src string"))
        assert {tuple(r) for r in got.collect()} == {(s, o) for s, objs in held.items() for o in objs}
        assert {tuple(r) for r in regions.collect()} == set(region.items())
    assert merges > 1
