"""Algorithms on one small group at a time: sequences, colourings, matchings. Groups are functions or components, whose
size does not grow with the data; each is worked out whole, many of them in one Arrow batch."""

from __future__ import annotations

import bisect
import functools
import itertools
from collections import defaultdict, deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def increasing(values: list) -> list:
    """A longest strictly increasing subsequence; of several the one that patience sorting finds."""
    tops: list = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(values[i])
        i = before[i]
    return out[::-1]


def common(a: list, b: list) -> int:
    """The length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def colouring(graph: dict) -> dict:
    """Lowest free colours, taking the node with most uncoloured neighbours next, ties by id."""
    out: dict = {}
    while len(out) < len(graph):
        n = min((x for x in graph if x not in out), key=lambda x: (-sum(y not in out for y in graph[x]), x))
        used = {out[y] for y in graph[n] if y in out}
        out[n] = next(c for c in range(len(graph)) if c not in used)
    return out


def cut_nodes(graph: dict) -> set:
    """Nodes whose removal parts their component."""
    low: dict = {}
    number: dict = {}
    out = set()
    for root in sorted(graph):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        children, stack = 0, [(root, None, iter(sorted(graph[root])))]
        while stack:
            n, up, rest = stack[-1]
            for m in rest:
                if m not in number:
                    number[m] = low[m] = len(number)
                    children += n == root
                    stack.append((m, n, iter(sorted(graph[m]))))
                    break
                if m != up:
                    low[n] = min(low[n], number[m])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[n])
                    if p != root and low[n] >= number[p]:
                        out.add(p)
        if children > 1:
            out.add(root)
    return out


def matching(graph: dict) -> dict:
    """A largest matching of a bipartite graph (left -> rights), by augmenting paths: right -> left."""
    owner: dict = {}
    for start in sorted(graph):
        came: dict = {}
        queue, end = deque([start]), None
        while queue and end is None:
            n = queue.popleft()
            for r in sorted(graph[n]):
                if r not in came:
                    came[r] = n
                    if r not in owner:
                        end = r
                        break
                    queue.append(owner[r])
        while end is not None:
            n = came[end]
            held = next((r for r, l in owner.items() if l == n), None)
            owner[end] = n
            end = held if n != start else None
    return owner


def lexicographic_order(graph: dict) -> list:
    """Lexicographic breadth-first order by partition refinement, ties by id."""
    parts, out = [sorted(graph)], []
    while parts:
        n = parts[0].pop(0)
        out.append(n)
        parts = [half for p in parts for half in ([x for x in p if x in graph[n]], [x for x in p if x not in graph[n]]) if half]
    return out


def neighbours(pairs: Iterable[tuple]) -> dict:
    out: dict = defaultdict(set)
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return dict(out)


#: Graphs whose results a task remembers.
REMEMBERED = 50_000


def per_graph(edges: DataFrame, key: str, function, schema: str) -> DataFrame:
    """``function`` of each key's neighbour sets gives its rows. A key's edges are one row, so a batch holds many graphs.

    Equal graphs are worked out once while a task remembers them. Edges that are dealt by the key are not shuffled again.
    """
    kinds = {"long": pa.int64(), "string": pa.string()}
    (_, named), *rest = (c.split() for c in schema.split(", "))
    out = pa.schema([(key, kinds[named]), *((name, kinds[kind]) for name, kind in rest)])

    def run(it):
        told = functools.lru_cache(REMEMBERED)(lambda pairs: list(function(neighbours(pairs))))
        for batch in it:
            lists = batch.column(1)
            ends, pairs = lists.offsets.to_pylist(), list(zip(*(lists.values.field(c).to_pylist() for c in ("src", "dst")), strict=True))
            found = [told(tuple(pairs[at:to])) for at, to in itertools.pairwise(ends)]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), list(map(len, found)))))
            columns = list(zip(*itertools.chain.from_iterable(found), strict=True)) or [()] * len(rest)
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, rest, strict=True))], schema=out)

    grouped = edges.groupBy(key).agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    return grouped.select(F.col(key).cast(named), "edges").mapInArrow(run, schema)
