"""Control-flow graphs of single functions, and what follows from them: dominance, control and data dependence, SSA.

A function's graph is small, so each is worked out whole inside one call; many functions are dealt out as rows.
"""

from __future__ import annotations

import ast
import functools
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shared import spread


class Flow:
    """The control-flow graph of a function: blocks of statements and labelled edges. Block 0 is the entry, 1 the exit."""

    def __init__(self, body: list[ast.stmt], params: list[str] = (), texts: bool = True):
        self._text = ast.unparse if texts else lambda s: ""
        self.kind = {0: "entry", 1: "exit"}
        self.edges: list[tuple[int, int, str]] = []
        self.defs: dict[int, list[str]] = defaultdict(list)
        self.uses: dict[int, list[str]] = defaultdict(list)
        self.exposed: dict[int, list[str]] = defaultdict(list)  # read before the block itself defines them
        self.code: dict[int, list[str]] = defaultdict(list)
        self.defs[0] = list(params)
        self.loops: list[tuple[int, int]] = []
        self.handlers: list[int] = []
        end = self.suite(body, self._after(0, "entry"))
        if end is not None:
            self.edges.append((end, 1, "normal"))
        self._trim()

    def _new(self, kind: str = "suite") -> int:
        k = max(self.kind) + 1
        self.kind[k] = kind
        return k

    def _after(self, at: int, label: str, kind: str = "suite") -> int:
        k = self._new(kind)
        self.edges.append((at, k, label))
        return k

    def _names(self, block: int, node: ast.AST) -> None:
        for n in ast.walk(node):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                self.defs[block].append(n.id)
            elif isinstance(n, ast.Name):
                self._read(block, n.id)

    def _read(self, block: int, name: str) -> None:
        self.uses[block].append(name)
        if name not in self.defs[block]:
            self.exposed[block].append(name)

    def suite(self, body: list[ast.stmt], at: int | None) -> int | None:
        for s in body:
            if at is None:
                return None
            at = self.statement(s, at)
        return at

    def statement(self, s: ast.stmt, at: int) -> int | None:
        if isinstance(s, ast.If):
            return self._if(s, at)
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            return self._loop(s, at)
        if isinstance(s, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            return self._try(s, at)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            for i in s.items:
                self._names(at, i)
            return self.suite(s.body, at)
        if isinstance(s, ast.Match):
            return self._match(s, at)
        self.code[at].append(self._text(s) if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else f"def {s.name}")
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.defs[at].append(s.name)
            return at
        if isinstance(s, (ast.Assign, ast.AugAssign, ast.AnnAssign)):
            if s.value is not None:
                self._names(at, s.value)
            if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                self._read(at, s.target.id)
            for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                self._names(at, t)
        else:
            self._names(at, s)
        if isinstance(s, ast.Return):
            self.edges.append((at, 1, "return"))
            return None
        if isinstance(s, ast.Raise):
            self.edges.append((at, self.handlers[-1] if self.handlers else 1, "fail"))
            return None
        if isinstance(s, (ast.Break, ast.Continue)) and self.loops:
            self.edges.append((at, self.loops[-1][isinstance(s, ast.Break)], "break" if isinstance(s, ast.Break) else "continue"))
            return None
        return at

    def _join(self, *ends: int | None) -> int | None:
        ends = [e for e in ends if e is not None]
        if not ends:
            return None
        k = self._new("merge")
        self.edges += [(e, k, "normal") for e in ends]
        return k

    def _if(self, s: ast.If, at: int) -> int | None:
        test = self._after(at, "normal", "switch")
        self._names(test, s.test)
        self.code[test].append(self._text(s.test))
        yes = self.suite(s.body, self._after(test, "true"))
        no = self.suite(s.orelse, self._after(test, "false"))
        return self._join(yes, no)

    def _loop(self, s, at: int) -> int | None:
        head = self._after(at, "normal", "loop")
        out = self._new("merge")
        if isinstance(s, ast.While):
            self._names(head, s.test)
            self.code[head].append(self._text(s.test))
        else:
            self._names(head, s.iter)
            self._names(head, s.target)
            self.code[head].append(f"{self._text(s.target)} in {self._text(s.iter)}")
        self.loops.append((head, out))
        end = self.suite(s.body, self._after(head, "true"))
        self.loops.pop()
        if end is not None:
            self.edges.append((end, head, "normal"))
        if not (isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and s.test.value):
            other = self.suite(s.orelse, self._after(head, "false"))
            if other is not None:
                self.edges.append((other, out, "normal"))
        return out if any(b == out for _, b, _ in self.edges) else None

    def _try(self, s, at: int) -> int | None:
        landing = self._new("handler")
        self.handlers.append(landing)
        begin = self._after(at, "normal")
        self.edges.append((begin, landing, "error"))
        end = self.suite(s.body, begin)
        self.handlers.pop()
        if end is not None:
            if end != begin:
                self.edges.append((end, landing, "error"))
            end = self.suite(s.orelse, end)
        ends = [end]
        for h in s.handlers:
            b = self._after(landing, "normal")
            if h.type is not None:
                self._names(b, h.type)
            if h.name:
                self.defs[b].append(h.name)
            ends.append(self.suite(h.body, b))
        if not s.handlers:
            self.edges.append((landing, self.handlers[-1] if self.handlers else 1, "error"))
        joined = self._join(*ends)
        return self.suite(s.finalbody, joined) if joined is not None else None

    def _match(self, s: ast.Match, at: int) -> int | None:
        test = self._after(at, "normal", "switch")
        self._names(test, s.subject)
        ends = []
        for k, c in enumerate(s.cases):
            b = self._after(test, f"case {k}")
            self.defs[b] += [n.name for n in ast.walk(c.pattern) if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name]
            ends.append(self.suite(c.body, b))
        return self._join(self._after(test, "false"), *ends)

    def _trim(self) -> None:
        """Drop blocks that the entry does not reach."""
        live = reachable(self.successors(), 0) | {1}
        self.kind = {k: v for k, v in self.kind.items() if k in live}
        self.edges = [e for e in dict.fromkeys(self.edges) if e[0] in live and e[1] in live]

    def successors(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {k: [] for k in self.kind}
        for a, b, _ in self.edges:
            out[a].append(b)
        return out


def reachable(graph: dict[int, list[int]], root: int) -> set[int]:
    seen, stack = {root}, [root]
    while stack:
        for b in graph.get(stack.pop(), ()):
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def dominator_sets(graph: dict[int, list[int]], root: int) -> dict[int, set[int]]:
    """All dominators of each node that the root reaches, by intersection over predecessors to a fixpoint."""
    live = reachable(graph, root)
    before: dict[int, set[int]] = defaultdict(set)
    for a in live:
        for b in graph[a]:
            before[b].add(a)
    doms = {n: set(live) for n in live}
    doms[root] = {root}
    changed = True
    while changed:
        changed = False
        for n in sorted(live - {root}):
            new = set.intersection(*(doms[p] for p in before[n])) | {n}
            if new != doms[n]:
                doms[n], changed = new, True
    return doms


def frontiers(graph: dict[int, list[int]], doms: dict[int, set[int]]) -> set[tuple[int, int]]:
    """(x, y): x dominates a predecessor of y, not y strictly."""
    return {(x, b) for a in doms for b in graph[a] for x in doms[a] if not (x in doms[b] and x != b)}


def flipped(graph: dict[int, list[int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {k: [] for k in graph}
    for a, bs in graph.items():
        for b in bs:
            out[b].append(a)
    return out


def control_dependences(flow: Flow, compat: bool = False) -> set[tuple[int, int, str]]:
    """(src, dst, label): dst runs or not as src decides. ``compat``: from the forward frontier, in its direction."""
    graph = flow.successors()
    label = {(a, b): l for a, b, l in flow.edges}
    if compat:
        return {(x, y, label.get((x, y), "control")) for x, y in frontiers(graph, dominator_sets(graph, 0))}
    back = flipped(graph)
    doms = dominator_sets(back, 1)
    return {(y, x, label.get((y, x), "control")) for x, y in frontiers(back, doms)}


def phis(flow: Flow) -> set[tuple[int, str]]:
    """(block, variable): where versions meet and the variable may still be read, by iterated frontiers and liveness."""
    graph = flow.successors()
    by = defaultdict(set)
    for x, y in frontiers(graph, dominator_sets(graph, 0)):
        by[x].add(y)
    live_in: dict[int, set[str]] = {n: set() for n in graph}
    changed = True
    while changed:
        changed = False
        for n in graph:
            out = set().union(*(live_in[b] for b in graph[n])) if graph[n] else set()
            new = set(flow.exposed.get(n, ())) | (out - set(flow.defs.get(n, ())))
            if new != live_in[n]:
                live_in[n], changed = new, True
    out = set()
    for v in {v for d in flow.defs.values() for v in d}:
        work, placed = [n for n, d in flow.defs.items() if v in d and n in graph], set()
        while work:
            for y in by[work.pop()]:
                if y not in placed:
                    placed.add(y)
                    work.append(y)
        out |= {(b, v) for b in placed if v in live_in[b]}
    return out


def reaching(flow: Flow) -> set[tuple[int, int, str]]:
    """(src, dst, variable): the definition in block src may reach a use in block dst."""
    graph = flow.successors()
    before = flipped(graph)
    inside: dict[int, set] = {n: set() for n in graph}
    changed = True
    while changed:
        changed = False
        for n in graph:
            new = set()
            for p in before[n]:
                kept = {(d, v) for d, v in inside[p] if v not in flow.defs.get(p, ())}
                new |= kept | {(p, v) for v in flow.defs.get(p, ())}
            if new != inside[n]:
                inside[n], changed = new, True
    return {(d, n, v) for n in graph for d, v in inside[n] if v in flow.exposed.get(n, ())}


def natural_loops(flow: Flow) -> set[tuple[int, int]]:
    """(head, block): the bodies of the loops that back edges close."""
    graph = flow.successors()
    doms, back = dominator_sets(graph, 0), flipped(graph)
    out = set()
    for a, b, _ in flow.edges:
        if a in doms and b in doms[a]:
            out |= {(b, n) for n in _until(back, a, b)}
    return out


def _until(back: dict[int, list[int]], start: int, head: int) -> set[int]:
    seen, stack = {head, start}, [start]
    while stack:
        n = stack.pop()
        if n != head:
            for p in back[n]:
                if p not in seen:
                    seen.add(p)
                    stack.append(p)
    return seen


@functools.cache
def _bodies(cls: type) -> tuple[str, ...]:
    """The fields of a node class that hold statements, or what holds some: functions are nowhere else."""
    return tuple(f for f in cls._fields if f in ("body", "handlers", "orelse", "finalbody", "cases"))


def flows(text: str, texts: bool = True) -> dict[str, Flow]:
    """The graph of each function of a source by qualified name, with its blocks' code or without; none if it does not parse."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return {}
    out: dict[str, Flow] = {}
    stack: list[tuple[ast.AST, str]] = [(tree, "main")]
    while stack:
        node, scope = stack.pop()
        for c in (c for f in _bodies(type(node)) for c in getattr(node, f)):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = c.args
                out[f"{scope}.{c.name}"] = Flow(c.body, [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]], texts)
                stack.append((c, f"{scope}.{c.name}"))
            elif _bodies(type(c)):
                stack.append((c, f"{scope}.{c.name}" if isinstance(c, ast.ClassDef) else scope))
    return out


#: Sources whose results a worker remembers.
REMEMBERED = 256


def per_function(files: DataFrame, facts, columns: dict[str, pa.DataType], texts: bool = True) -> DataFrame:
    """(file_id, func, *columns): the tuples that ``facts`` gives for each function's graph, which has no code without ``texts``.

    Equal sources are worked out once while a worker remembers them.
    """
    schema = pa.schema([("file_id", pa.int64()), ("func", pa.string()), *columns.items()])
    ddl = {pa.int32(): "int", pa.string(): "string"}

    def run(it):
        told = functools.lru_cache(REMEMBERED)(lambda t: [(name, *r) for name, flow in flows(t, texts).items() for r in sorted(facts(flow))])
        for batch in it:
            rows = [(i, *r) for i, t in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True) for r in told(t)]
            arrays = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(arrays, schema, strict=True)], schema=schema)

    return spread(files.select("file_id", "text"), "file_id").mapInArrow(run, ", ".join(["file_id long, func string", *(f"{n} {ddl[t]}" for n, t in columns.items())]))


_I, _S = pa.int32(), pa.string()


def blocks(files: DataFrame) -> DataFrame:
    return per_function(files, lambda f: [(k, v, "; ".join(f.code.get(k, []))) for k, v in f.kind.items()], {"block": _I, "kind": _S, "code": _S})


def edges(files: DataFrame) -> DataFrame:
    return per_function(files, lambda f: f.edges, {"src": _I, "dst": _I, "label": _S}, False)


def dominance(files: DataFrame) -> DataFrame:
    return per_function(files, lambda f: [(n, d) for n, s in dominator_sets(f.successors(), 0).items() for d in s], {"node": _I, "dom": _I}, False)


def control(files: DataFrame, compat: bool = False) -> DataFrame:
    return per_function(files, lambda f: control_dependences(f, compat), {"src": _I, "dst": _I, "label": _S}, False)


def data(files: DataFrame) -> DataFrame:
    return per_function(files, reaching, {"src": _I, "dst": _I, "var": _S})


def ssa(files: DataFrame) -> DataFrame:
    return per_function(files, phis, {"block": _I, "var": _S})


def loops(files: DataFrame) -> DataFrame:
    return per_function(files, natural_loops, {"head": _I, "block": _I}, False)


def inlinable(files: DataFrame) -> DataFrame:
    """(file_id, func): functions without a return inside a loop."""

    def facts(f: Flow) -> list[tuple]:
        inside = {b for _, b in natural_loops(f)}
        return [] if any(label == "return" and a in inside for a, _, label in f.edges) else [()]

    return per_function(files, facts, {}, False)


def overwritten(f: Flow, block: int) -> set[str]:
    """Variables that a block's plain assignment sets and a later one sets again before any read; none where an error may leave the block in between."""
    if any(a == block and label == "error" for a, _, label in f.edges):
        return set()
    out, pending = set(), set()
    for text in f.code.get(block, ()):
        try:
            (statement,) = ast.parse(text).body
        except (SyntaxError, ValueError):
            pending.clear()
            continue
        names = [n for n in ast.walk(statement) if isinstance(n, ast.Name)]
        pending -= {n.id for n in names if not isinstance(n.ctx, ast.Store)}
        if isinstance(statement, ast.AugAssign):
            pending -= {n.id for n in names}
        elif isinstance(statement, ast.Assign) and all(isinstance(t, ast.Name) for t in statement.targets):
            stored = {t.id for t in statement.targets}
            out |= stored & pending
            pending |= stored
    return out


def liveness(files: DataFrame) -> DataFrame:
    """(file_id, func, block, var): definitions that no later use needs; their plain assignments are dead."""

    def dead(f: Flow):
        used = {(d, v) for d, _, v in reaching(f)}
        last = {(n, v) for n, vs in f.defs.items() if n in f.kind and n > 1 for v in vs if (n, v) not in used and v not in f.uses.get(n, ())}
        return sorted(last | {(n, v) for n in f.kind for v in overwritten(f, n)})

    return per_function(files, dead, {"block": _I, "var": _S})
