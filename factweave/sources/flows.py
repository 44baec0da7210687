"""Name flow in source files as facts: which expressions hold which objects, are read from, stored to, called and iterated.

A slot is a place that holds objects: a variable (``module.function.name``), a result (``f.<return>``) or an expression. An
object is a kind and a name: f function, c class, m module, x what is not in the sources, o a container, k a constant.
"""

from __future__ import annotations

import ast
import builtins

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spread

FACT = "project string, kind string, a string, b string, c string, n int"
_SCHEMA = pa.schema([*((c, pa.string()) for c in ("project", "kind", "a", "b", "c")), ("n", pa.int32())])
_DECORATED = {"staticmethod": "static", "classmethod": "class"}
_CONTAINERS = {ast.List: "<**PyList**>", ast.Tuple: "<**PyTuple**>", ast.Set: "<**PySet**>", ast.Dict: "<**PyDict**>"}
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


def _bound(body: list[ast.AST]) -> tuple[set[str], set[str]]:
    """Names that a scope's statements bind, inner scopes aside, and those it declares global or nonlocal."""
    names, outer, todo = set(), set(), list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names.add(node.name)
            todo += node.decorator_list
        elif isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Load):
            names.add(node.id)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            outer |= set(node.names)
        elif isinstance(node, ast.alias):
            names.add(node.asname or node.name.split(".")[0])
        elif isinstance(node, ast.ExceptHandler) and node.name:
            names.add(node.name)
        if not isinstance(node, _SCOPES):
            todo += ast.iter_child_nodes(node)
    return names - outer, outer


class _Scope:
    def __init__(self, name: str, names: set[str], is_class: bool, up: _Scope | None, caller: str, first: str | None = None, owner: str | None = None):
        self.name, self.names, self.is_class, self.up, self.caller, self.first, self.owner = name, names, is_class, up, caller, first, owner
        self.lambdas = 0


class _File:
    """Facts of one file."""

    def __init__(self, module: str, package: str, tree: ast.Module):
        self.module, self.package, self.out, self.temps = module, package, [], 0
        self.top = _Scope(module, _bound(tree.body)[0], False, None, module)
        self.star = any(isinstance(n, ast.ImportFrom) and n.names[0].name == "*" for n in ast.walk(tree))
        self.add("module", module)
        for name in self.top.names:
            self.add("name", module, name)
        self.statements(tree.body, self.top)

    def add(self, kind: str, a: str, b: str | None = None, c: str | None = None, n: int | None = None) -> None:
        self.out.append((kind, a, b, c, n))

    def temp(self) -> str:
        self.temps += 1
        return f"{self.module}.<{self.temps}>"

    def holds(self, obj: str) -> str:
        slot = self.temp()
        self.add("pts", slot, obj)
        return slot

    def place(self, name: str, scope: _Scope) -> str | None:
        """The slot of a name; None for a builtin."""
        at: _Scope | None = scope
        while at is not None:
            if name in at.names and (not at.is_class or at is scope):
                return f"{at.name}.{name}"
            at = at.up
        return f"{self.module}.{name}" if self.star and not hasattr(builtins, name) else None

    # Statements

    def statements(self, body: list[ast.AST], scope: _Scope) -> None:
        for node in body:
            self.statement(node, scope)

    def statement(self, node: ast.AST, scope: _Scope) -> None:
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                self.decorated(node, self.function(node, scope), scope)
            case ast.ClassDef():
                self.decorated(node, self.klass(node, scope), scope)
            case ast.Assign(targets=targets, value=value):
                slot = self.value(value, scope)
                for t in targets:
                    self.assign(t, slot, scope, value)
            case ast.AnnAssign(target=t, value=value) if value is not None:
                self.assign(t, self.value(value, scope), scope, value)
            case ast.AugAssign(target=t, value=value):
                self.assign(t, self.value(value, scope), scope, None)
            case ast.Return(value=value) if value is not None:
                self.add("copy", self.value(value, scope), f"{scope.name}.<return>")
            case ast.For() | ast.AsyncFor():
                self.loop(node.target, node.iter, scope)
                self.statements([*node.body, *node.orelse], scope)
            case ast.With() | ast.AsyncWith():
                for item in node.items:
                    slot = self.value(item.context_expr, scope)
                    if item.optional_vars is not None:
                        self.assign(item.optional_vars, slot, scope, None)
                self.statements(node.body, scope)
            case ast.Raise(exc=exc) if exc is not None:
                slot = self.value(exc, scope)
                if not isinstance(exc, ast.Call):
                    self.call(slot, [], [], scope)
            case ast.Import(names=names):
                for a in names:
                    self.add("pts", f"{scope.name}.{a.asname or a.name.split('.')[0]}", f"m:{a.name if a.asname else a.name.split('.')[0]}")
            case ast.ImportFrom():
                self.imported(node, scope)
            case _:
                for field in ast.iter_child_nodes(node):
                    if isinstance(field, ast.expr):
                        self.value(field, scope)
                    elif not isinstance(field, ast.expr_context):
                        self.statement(field, scope)

    def imported(self, node: ast.ImportFrom, scope: _Scope) -> None:
        base = node.module or ""
        if node.level:
            above = self.package.split(".") if self.package else []
            above = above[: len(above) - node.level + 1]
            base = ".".join([*above, *filter(None, [node.module])])
        slot = self.holds(f"m:{base}")
        for a in node.names:
            if a.name == "*":
                self.add("star", base, scope.name)
            else:
                self.add("load", slot, a.name, f"{scope.name}.{a.asname or a.name}")

    def decorated(self, node, obj: str, scope: _Scope) -> None:
        slot = self.holds(obj)
        for d in reversed(node.decorator_list):
            if not (isinstance(d, ast.Name) and d.id in _DECORATED):
                slot = self.call(self.value(d, scope), [slot], [], scope)
        self.add("copy", slot, f"{scope.name}.{node.name}")

    def function(self, node, scope: _Scope) -> str:
        is_lambda = isinstance(node, ast.Lambda)
        if is_lambda:
            scope.lambdas += 1
        name = f"{scope.name}.<lambda{scope.lambdas}>" if is_lambda else f"{scope.name}.{node.name}"
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        every = [*plain, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]
        body = [ast.Return(node.body)] if is_lambda else node.body
        names, outer = _bound(body)
        inner = _Scope(name, (names | {x.arg for x in every}) - outer, False, scope, name, f"{name}.{plain[0].arg}" if plain else None, scope.name if scope.is_class else scope.owner)
        kind = next((_DECORATED[d.id] for d in getattr(node, "decorator_list", []) if isinstance(d, ast.Name) and d.id in _DECORATED), "plain")
        self.add("function", name, kind)
        for k, x in enumerate(plain):
            self.add("param", name, x.arg, f"{name}.{x.arg}", k)
        for x in a.kwonlyargs:
            self.add("param", name, x.arg, f"{name}.{x.arg}", -1)
        if a.vararg:
            self.add("pts", f"{name}.{a.vararg.arg}", f"o:{name}.*")
            self.add("rest", name, f"o:{name}.*", None, len(plain))
        if a.kwarg:
            self.add("pts", f"{name}.{a.kwarg.arg}", f"o:{name}.**")
        for x, d in [*zip(reversed(plain), reversed(a.defaults), strict=False), *((x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None)]:
            self.add("copy", self.value(d, scope), f"{name}.{x.arg}")
        self.statements(body, inner)
        return f"f:{name}"

    def klass(self, node: ast.ClassDef, scope: _Scope) -> str:
        name = f"{scope.name}.{node.name}"
        self.add("class", name)
        for k, b in enumerate(node.bases):
            self.add("base", name, self.value(b, scope), None, k)
        names = _bound(node.body)[0]
        for x in names:
            self.add("member", name, x)
        self.statements(node.body, _Scope(name, names, True, scope, scope.caller))
        return f"c:{name}"

    def assign(self, target: ast.AST, slot: str, scope: _Scope, value: ast.AST | None) -> None:
        match target:
            case ast.Name(id=name):
                self.add("copy", slot, self.place(name, scope) or f"{scope.name}.{name}")
            case ast.Attribute(value=base, attr=attr):
                self.add("store", self.value(base, scope), attr, slot)
            case ast.Subscript(value=base, slice=key):
                self.add("store_at", self.value(base, scope), self.value(key, scope), slot)
            case ast.Starred(value=inner):
                self.assign(inner, slot, scope, value)
            case ast.Tuple(elts=parts) | ast.List(elts=parts):
                stars = [k for k, p in enumerate(parts) if isinstance(p, ast.Starred)]
                known = value.elts if isinstance(value, (ast.Tuple, ast.List)) and not any(isinstance(v, ast.Starred) for v in value.elts) else None
                for k, p in enumerate(parts):
                    got = self.temp()
                    if isinstance(p, ast.Starred):
                        if known is not None:
                            obj = self.container("<**PyList**>", [(f"k:{j}", self.value(v, scope)) for j, v in enumerate(known[k : len(known) - (len(parts) - k - 1)])])
                            self.add("copy", obj, got)
                        else:
                            self.add("iter", slot, got, scope.caller)
                    elif not stars or k < stars[0]:
                        self.add("load_at", slot, self.holds(f"k:{k}"), got)
                    elif known is not None:
                        self.add("load_at", slot, self.holds(f"k:{len(known) - len(parts) + k}"), got)
                    else:
                        self.add("iter", slot, got, scope.caller)
                    self.assign(p, got, scope, known[k] if known and not stars and k < len(known) else None)

    def loop(self, target: ast.AST, source: ast.AST, scope: _Scope) -> None:
        got = self.temp()
        self.add("iter", self.value(source, scope), got, scope.caller)
        self.assign(target, got, scope, None)

    # Expressions

    def container(self, kind: str, items: list[tuple[str | None, str]]) -> str:
        """A new container; items are (constant key object or None for any, slot)."""
        slot = self.temp()
        obj = f"o:{slot}"
        self.add("pts", slot, obj)
        self.add("like", obj, kind)
        for key, value in items:
            self.add("copy", value, f"{obj}[{'*' if key is None else key[2:]}]")
        return slot

    def call(self, func: str, args: list[str], named: list[tuple[str, str]], scope: _Scope) -> str:
        got = self.temp()
        self.add("call", func, got, scope.caller)
        for k, a in enumerate(args):
            self.add("arg", got, None, a, k)
        for name, a in named:
            self.add("arg", got, name, a)
        return got

    def value(self, node: ast.AST, scope: _Scope) -> str:
        """The slot of an expression's objects."""
        match node:
            case ast.Name(id=name):
                slot = self.place(name, scope)
                return slot if slot is not None else self.holds(f"x:<builtin>.{name}") if hasattr(builtins, name) else self.temp()
            case ast.Constant(value=bool() | None):
                return self.temp()
            case ast.Constant(value=str() | int() | float() as v):
                slot = self.holds(f"k:{v}")
                if isinstance(v, str):
                    self.add("pts", slot, "x:<**PyStr**>")
                return slot
            case ast.Attribute(value=base, attr=attr):
                got = self.temp()
                self.add("load", self.value(base, scope), attr, got)
                return got
            case ast.Subscript(value=base, slice=ast.Slice(lower=low)):
                got, begin = self.container("<**PyList**>", []), getattr(low, "value", 0)
                self.add("shift", self.value(base, scope), f"o:{got}", None, begin if isinstance(begin, int) else 0)
                return got
            case ast.Subscript(value=base, slice=key):
                got = self.temp()
                self.add("load_at", self.value(base, scope), self.value(key, scope), got)
                return got
            case ast.List(elts=items) | ast.Tuple(elts=items) | ast.Set(elts=items):
                return self.container(_CONTAINERS[type(node)], [(None if isinstance(x, ast.Starred) else f"k:{k}", self.value(x, scope)) for k, x in enumerate(items)])
            case ast.Dict(keys=keys, values=values):
                slot = self.container("<**PyDict**>", [])
                for k, v in zip(keys, values, strict=True):
                    if k is not None:
                        self.add("store_at", slot, self.value(k, scope), self.value(v, scope))
                return slot
            case ast.Lambda():
                return self.holds(self.function(node, scope))
            case ast.Call():
                return self.called(node, scope)
            case ast.IfExp(test=test, body=a, orelse=b):
                self.value(test, scope)
                return self.joined([self.value(a, scope), self.value(b, scope)])
            case ast.BoolOp(values=values):
                return self.joined([self.value(v, scope) for v in values])
            case ast.NamedExpr(target=t, value=v):
                slot = self.value(v, scope)
                self.assign(t, slot, scope, v)
                return slot
            case ast.Await(value=v) | ast.Starred(value=v):
                return self.value(v, scope)
            case ast.Yield(value=v) | ast.YieldFrom(value=v):
                self.add("yields", scope.name)
                if v is not None:
                    slot = self.value(v, scope)
                    if isinstance(node, ast.YieldFrom):
                        self.add("iter", slot, f"{scope.name}.<yield>", scope.caller)
                    else:
                        self.add("copy", slot, f"{scope.name}.<yield>")
                return self.temp()
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp() | ast.DictComp():
                inner = _Scope(scope.name, scope.names | {n.id for g in node.generators for n in ast.walk(g.target) if isinstance(n, ast.Name)}, scope.is_class, scope.up, scope.caller, scope.first, scope.owner)
                for g in node.generators:
                    self.loop(g.target, g.iter, inner)
                    for test in g.ifs:
                        self.value(test, inner)
                if isinstance(node, ast.DictComp):
                    self.value(node.key, inner)
                return self.container("<**PyDict**>" if isinstance(node, ast.DictComp) else "<**PyList**>", [(None, self.value(node.value if isinstance(node, ast.DictComp) else node.elt, inner))])
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr):
                self.value(child, scope)
        return self.temp()

    def joined(self, slots: list[str]) -> str:
        got = self.temp()
        for s in slots:
            self.add("copy", s, got)
        return got

    def called(self, node: ast.Call, scope: _Scope) -> str:
        func = self.value(node.func, scope)
        args = [self.value(a, scope) for a in node.args if not isinstance(a, ast.Starred)]
        spread = [self.value(a.value, scope) for a in node.args if isinstance(a, ast.Starred)]
        for s in spread:
            self.add("iter", s, got := self.temp(), scope.caller)
            args.append(got)
        named = [(k.arg, self.value(k.value, scope)) for k in node.keywords if k.arg]
        for k in node.keywords:
            if k.arg is None:
                self.value(k.value, scope)
        got = self.call(func, args, named, scope)
        match node.func:
            case ast.Name(id="super") if scope.owner and scope.first and self.place("super", scope) is None:
                self.add("super", scope.first, scope.owner, got)
            case ast.Name(id="map" | "filter" as name) if self.place(name, scope) is None:
                results = []
                for k, a in enumerate(args):
                    given = self.temp()
                    for j, other in enumerate(args):
                        if j != k:
                            self.add("iter", other, given, scope.caller)
                    results.append((None, self.call(a, [given], [], scope)))
                self.add("copy", self.container("<**PyList**>", results), got)
            case ast.Attribute(value=base, attr="append" | "add" | "insert") if args:
                self.add("fill", self.value(base, scope), args[-1])
            case ast.Attribute(value=base, attr="update" | "extend") if args:
                self.add("merge", self.value(base, scope), args[0])
        return got


def facts(project: str, path: str, text: str) -> list[tuple]:
    """Facts of one source; none if it does not parse. A module is named by its path."""
    try:
        tree = ast.parse(text or "")
        parts = [p for p in (path or "").split("/") if p]
        last = parts[-1].removesuffix(".py") if parts else "main"
        package = ".".join(parts[:-1])
        module = package if last == "__init__" and package else ".".join([*parts[:-1], last])
        return [(project, *f) for f in _File(module, package, tree).out]
    except (SyntaxError, ValueError, RecursionError):
        return []


def flow_facts(files: DataFrame) -> DataFrame:
    """Facts of files (project, path, text); paths are relative to their project's root."""

    def run(it):
        for batch in it:
            rows = [f for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in facts(*row)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return spread(files.select(F.col("project").cast("string"), "path", "text")).mapInArrow(run, FACT)
