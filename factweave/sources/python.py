"""Python source as relational facts. Source text is parsed, never run."""

from __future__ import annotations

import ast
import functools
import io
import re
import tokenize
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import glob_regex, module_name
from ..shared import spread

NODE = """file_id long, node_id int, parent_id int, field string, idx int, kind string, lineno int, end_lineno int, col int, end_col int,
 name string, value string, value_kind string, qualname string, scope string,
 args array<struct<kind: string, name: string, value: string, outside: string>>, kw map<string, string>, context array<string>"""
_ARROW = {"file_id": pa.int64(), "args": pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("outside", pa.string())])), "kw": pa.map_(pa.string(), pa.string()), "context": pa.list_(pa.string())} | dict.fromkeys(("node_id", "parent_id", "idx", "lineno", "end_lineno", "col", "end_col"), pa.int32())
#: Files whose nodes are held at once.
CHUNK = 500
_NODE_COLUMNS = re.findall(r"(\w+) (?:long|int|string|array<struct|map|array<string)", NODE)


def find_files(spark: SparkSession, path: str, include: tuple[str, ...] = ("*.py",), exclude: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path, length) of the .py files under a folder whose names match an include pattern and no exclude pattern.

    A file in an excluded folder is left out when the search is recursive.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.py").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    some = lambda c, patterns: F.greatest(*[c.rlike(glob_regex(p)) for p in patterns], F.lit(False))
    kept = found.filter(some(name, include) & ~some(name, exclude))
    if recursive:
        for p in exclude:
            kept = kept.filter(~F.exists(F.split(F.col("path"), "/"), lambda x, p=p: x.rlike(glob_regex(p))))
    return kept.orderBy("path")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, text) of all .py files under a folder."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return raw.select(F.xxhash64("path").alias("file_id"), "path", F.col("value").alias("text"))


def modules(files: DataFrame) -> DataFrame:
    """(module, path)."""
    return files.select(module_name("path").alias("module"), "path")


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return ".".join(["", *reversed(parts)]).lstrip(".") or None if parts else None


def _resolved(name: str | None, aliases: dict[str, str]) -> str | None:
    """The name with its longest aliased prefix put in full, by the aliases seen so far."""
    if not name:
        return name
    parts = name.split(".")
    for k in range(len(parts), 0, -1):
        if (head := ".".join(parts[:k])) in aliases:
            return ".".join([aliases[head], *parts[k:]])
    return name


def _literal(node: ast.AST) -> tuple[str | None, str | None]:
    """A constant's text and kind."""
    if isinstance(node, ast.Constant):
        v = node.value
        kind = "none" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str" if isinstance(v, str) else "bytes" if isinstance(v, bytes) else "other"
        return (v if isinstance(v, str) else v.decode("latin-1") if isinstance(v, bytes) else repr(v)), kind
    return None, None


def _names(target: ast.AST) -> list[str]:
    return [target.id] if isinstance(target, ast.Name) else [target.attr] if isinstance(target, ast.Attribute) else []


def _context(node: ast.Constant, parents: dict) -> list[str]:
    """Names that a string constant is assigned to or compared with."""
    up = parents.get(node)
    if isinstance(up, ast.Assign):
        return [x for t in up.targets for x in _names(t)]
    if isinstance(up, ast.Subscript) and isinstance(over := parents.get(up), ast.Assign) and isinstance(over.value, ast.Constant) and isinstance(over.value.value, str):
        return [node.value]
    if isinstance(up, ast.Compare) and up.comparators and isinstance(up.comparators[0], ast.Constant) and isinstance(up.comparators[0].value, str):
        return _names(up.left)
    return []


#: Parts of names, whole names, called attributes, objects and their attributes that bring input from outside, and
#: attributes that build strings, words of checked names and called checks (fixed values).
INPUT_PARTS = ("input", "get", "post", "request", "query", "params", "args", "form", "data", "body", "json", "xml", "yaml", "csv", "load", "parse", "decode", "deserialize", "unmarshal", "read", "open", "file", "stream", "socket", "network", "url", "path", "filename", "content", "message", "payload")
INPUT_NAMES = ("request", "req", "params", "args", "kwargs", "data", "form")
INPUT_CALLS = ("get", "post", "input", "read", "load", "parse")
INPUT_OBJECTS = ("request", "req", "self")
INPUT_FIELDS = ("args", "form", "data", "json", "values", "get", "post")
STRING_CALLS = ("format", "replace", "join", "strip")
CHECKED_WORDS = ("whitelist", "allowed", "valid", "safe")
CHECK_CALLS = ("validate", "sanitize", "escape", "clean", "check", "verify")


def _given(node: ast.AST) -> bool:
    """Whether an expression is input from outside, by its names."""
    match node:
        case ast.Name(id=name):
            return name.lower() in INPUT_NAMES or any(x in name.lower() for x in INPUT_PARTS)
        case ast.Call(func=ast.Attribute(attr=name)):
            return name.lower() in INPUT_CALLS
        case ast.Attribute(value=ast.Name(id=owner), attr=name):
            return owner.lower() in INPUT_OBJECTS and name.lower() in INPUT_FIELDS
    return False


def _outside(node: ast.AST) -> str | None:
    """``given`` for input from outside, ``built`` for a string with such input in it."""
    if _given(node):
        return "built" if isinstance(node, ast.Call) and node.func.attr in STRING_CALLS else "given"
    match node:
        case ast.Call(func=ast.Attribute(attr=name), args=args) if name in STRING_CALLS:
            return "built" if any(map(_given, args)) else None
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            return "built" if _outside(left) or _outside(right) else None
    return None


def _checked(up: ast.AST | None) -> bool:
    """Whether a statement stands under a condition that checks its input."""
    match up:
        case ast.If(test=ast.Compare(left=ast.Name(id=name))):
            return any(x in name.lower() for x in CHECKED_WORDS)
        case ast.If(test=ast.Call(func=ast.Attribute(attr=name))):
            return name.lower() in CHECK_CALLS
    return False


#: Fields that never hold nodes.
_PLAIN = {"ctx", "id", "attr", "asname", "module", "level", "type_comment", "conversion", "lineno", "tag"}
_SCOPES = {"FunctionDef", "AsyncFunctionDef", "ClassDef"}
#: Kinds that say how others are named.
_TELLING = {"Import", "ImportFrom", *_SCOPES}


@functools.cache
def _shape(cls: type) -> tuple[str, tuple[str, ...], bool]:
    """A node class's name, its fields that may hold nodes, and whether it has a place in the text."""
    return cls.__name__, () if cls is ast.Constant else tuple(f for f in cls._fields if f not in _PLAIN), bool(cls._attributes)


def node_rows(file_id: int, text: str, kinds: frozenset[str] | None = None) -> list[tuple]:
    """The nodes of one source in pre-order, or those of some kinds; none if it does not parse."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []
    parents: dict = {}
    aliases: dict[str, str] = {}
    stack = [(tree, None, "", 0, "main")]
    me = -1
    while stack:
        node, up, field, idx, scope = stack.pop()
        me += 1
        label, fields, placed = _shape(type(node))
        name = value = kind = qual = None
        args, kw, context = [], {}, []
        if kinds is not None and label not in kinds and label not in _TELLING:
            pass
        elif isinstance(node, ast.Import):
            for a in node.names:
                if a.asname:
                    aliases[a.asname] = a.name
        elif isinstance(node, ast.ImportFrom):
            name = node.module
            for a in node.names:
                aliases[a.asname or a.name] = f"{node.module}.{a.name}" if node.module else a.name
        elif isinstance(node, ast.alias):
            name, value = node.name, node.asname
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = node.name
            qual = f"{scope}.{name}"
            if not isinstance(node, ast.ClassDef):
                plain = node.args.args
                for a, d in zip(reversed(plain), reversed(node.args.defaults), strict=False):
                    v, k = _literal(d)
                    args.append({"kind": k or type(d).__name__, "name": a.arg, "value": v, "outside": None})
                args.reverse()
        elif isinstance(node, ast.Call):
            qual = _resolved(_dotted(node.func), aliases)
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            for a in node.args:
                v, k = _literal(a)
                args.append({"kind": k or type(a).__name__, "name": _dotted(a) or (a.func.id if isinstance(a, ast.Call) and isinstance(a.func, ast.Name) else None), "value": v, "outside": _outside(a)})
            for k in node.keywords:
                v, lk = _literal(k.value)
                if k.arg and lk:
                    kw[k.arg] = f"{lk}:{v}"
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Attribute) and t.attr == "__dict__" for t in node.targets):
            value = "__dict__"
            kind = "checked" if _checked(parents.get(node)) else None
            args = [{"kind": type(node.value).__name__, "name": _dotted(node.value), "value": None, "outside": _outside(node.value)}]
        elif isinstance(node, ast.Constant):
            value, kind = _literal(node)
            if kind == "str":
                context = _context(node, parents)
        elif isinstance(node, ast.Name):
            name, value = node.id, type(node.ctx).__name__
        elif isinstance(node, ast.Attribute):
            name, value = node.attr, type(node.ctx).__name__
        elif isinstance(node, ast.arg):
            name = node.arg
        elif isinstance(node, ast.keyword):
            name = node.arg
        if kinds is None or label in kinds:
            place = (node.lineno, node.end_lineno, node.col_offset, node.end_col_offset) if placed else (None, None, None, None)
            out.append((file_id, me, up, field, idx, label, *place, name, value, kind, qual, scope, args, list(kw.items()), context))
        inner = qual if label in _SCOPES else scope
        children = []
        for f in fields:
            v = getattr(node, f, None)
            if isinstance(v, list):
                for k, c in enumerate(v):
                    if isinstance(c, ast.AST):
                        parents[c] = node
                        children.append((c, me, f, k, inner))
            elif isinstance(v, ast.AST):
                parents[v] = node
                children.append((v, me, f, 0, inner))
        children.reverse()
        stack += children
    return out


def parse(files: DataFrame, kinds: Iterable[str] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """ast_node rows of files (file_id, text); a file that does not parse has none.

    ``kinds`` and ``columns`` say which nodes and what of them is asked for, so that the rest is not made: most of a file's
    nodes are names and constants, and lists of arguments are costly to hand over.
    """
    wanted = None if kinds is None else frozenset(kinds)
    chosen = [k for k, c in enumerate(_NODE_COLUMNS) if columns is None or c in set(columns)]
    schema = pa.schema([(_NODE_COLUMNS[k], _ARROW.get(_NODE_COLUMNS[k], pa.string())) for k in chosen])

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, CHUNK):
                ids, texts = (batch.column(k).slice(at, CHUNK).to_pylist() for k in range(2))
                rows = [r for i, t in zip(ids, texts, strict=True) for r in node_rows(i, t, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in zip(chosen, schema, strict=True)], schema=schema)

    whole = StructType.fromDDL(NODE)
    return spread(files.select("file_id", "text"), "file_id").mapInArrow(run, StructType([whole[k] for k in chosen]))


def suppressions(files: DataFrame) -> DataFrame:
    """(file_id, line, ids) of all comments: the tests they suppress, none for all; null where they suppress nothing.

    Of names joined by commas alone the last counts.
    """
    mark = re.compile(r"#\s*nosec:?\s*(?P<ids>[^#]*)")
    chain = re.compile(r"(?:(B\d+|[a-z\d_]+),?)+", re.I)

    def run(it):
        for frame in it:
            out = []
            for i, t in zip(frame["file_id"], frame["text"], strict=True):
                if not t or "#" not in t:
                    continue
                try:
                    for token in tokenize.generate_tokens(io.StringIO(t).readline):
                        if token.type == tokenize.COMMENT:
                            m = mark.search(token.string)
                            out.append((i, token.start[0], [x[1] for x in chain.finditer(m["ids"])] if m else None))
                except (tokenize.TokenError, SyntaxError, IndentationError):
                    continue
            yield pd.DataFrame(out, columns=["file_id", "line", "ids"]).astype({"file_id": "int64", "line": "int32"})

    return spread(files.select("file_id", "text"), "file_id").mapInPandas(run, "file_id long, line int, ids array<string>")


def imports(nodes: DataFrame) -> DataFrame:
    """(file_id, module) of all imports."""
    plain = nodes.filter("kind = 'alias'").join(nodes.filter("kind = 'Import'").select("file_id", F.col("node_id").alias("parent_id")), ["file_id", "parent_id"]).select("file_id", F.col("name").alias("module"))
    return plain.union(nodes.filter("kind = 'ImportFrom' and name is not null").select("file_id", "name")).distinct()


def functions(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, qualname, kind) of functions and classes."""
    return nodes.filter(F.col("kind").isin("FunctionDef", "AsyncFunctionDef", "ClassDef")).select("file_id", "node_id", "qualname", "kind")


def definitions_and_uses(nodes: DataFrame) -> DataFrame:
    """(file_id, scope, name, mode, times): names stored, loaded or deleted in each scope."""
    return nodes.filter("kind = 'Name'").groupBy("file_id", "scope", "name", F.lower("value").alias("mode")).agg(F.count("*").alias("times"))
