"""Call graphs by points-to analysis: which objects each place may hold and which calls reach which functions, in one fixpoint.

Rows of the fixpoint are (project, kind, a, b, c, d, e): ``P`` place a holds object b; other kinds say what becomes of the
objects of place a (copy to b, bind to a receiver, read or write under a key, fill a container); ``E`` is a call edge. New
objects meet all uses of their place and new uses all objects of theirs, both by equality of (project, place). Attributes are
found along the method resolution order (C3), which a first fixpoint without calls prepares.

Projects are apart from each other. Instances of one class are one object. A key that is no constant of the sources reads
only what was stored without a key; names of objects from outside have at most ``PARTS`` parts, so that the result is finite.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..shared import written
from ..sources import flows
from . import alike
from .fixpoint import FEW, brief, fixpoint

PARTS = 12
_USES = ("copy", "load", "load_i", "store", "load_at", "store_at", "iter", "call", "super", "fill", "merge", "shift")
_DYNAMIC = ("copy", "bind", "read", "write", "into")
_COLUMNS = ["project", "kind", "a", "b", "c", "d", "e"]


def _row(kind: str, *parts: str) -> str:
    named = ", ".join(f"'{k}', {v}" for k, v in zip("abcde", [*parts, *["''"] * (5 - len(parts))], strict=True))
    return f"named_struct('kind', '{kind}', {named})"


def _copy(a: str, b: str) -> str:
    return _row("copy", a, b)


_ATTR = "concat(x, '.', b)"
_INVOKE = ", ".join([_row("E", "c", "x"), _row("T", "b", "x", "'{0}'"), *(_copy(f"concat(x, '.<{r}>')", "if(n = 1, concat(b, '<none>'), b)") for r in ("return", "generator"))])
_FILLED = ", ".join([_copy("b", "concat(o, '[*]')"), _copy("b", "concat(o, '[]')")])
#: What a place's object (o, of kind k and name x) gives by a use (u, with b, c, n) of the place.
_GIVES = f"""case u
  when 'copy' then array({_row("P", "b", "o")})
  when 'bind' then if(k = 'f', array({_row("BF", "x", "b", "c")}), array({_row("P", "b", "o")}))
  when 'load' then case k
    when 'm' then array({_row("ML", "x", "b", "c")})
    when 'c' then array({_row("L", "x", "''", "b", "c", "o")}, {_copy(_ATTR, "c")})
    when 'i' then array({_row("L", "x", "''", "b", "c", "o")}, {_copy("concat(o, '#', b)", "c")})
    when 's' then array({_row("L", "substring_index(x, '>', -1)", "substring_index(x, '>', 1)", "b", "c", "concat('i:', substring_index(x, '>', -1))")})
    when 'x' then if(size(split(x, '[.]')) < {PARTS}, array({_row("P", "c", f"concat('x:', {_ATTR})")}), null)
    when 'o' then array({_row("LK", "o", "b", "c")})
    else array({_copy("concat('f:', x, '#', b)", "c")}) end
  when 'load_i' then if(k = 'i', array({_row("L", "x", "''", "b", "c", "o")}), null)
  when 'store' then case when k in ('m', 'c') then array({_copy("c", _ATTR)}) when k = 'i' then array({_copy("c", "concat(o, '#', b)")}) when k in ('f', 'b') then array({_copy("c", "concat('f:', x, '#', b)")}) end
  when 'load_at' then if(k = 'o', array({_row("read", "b", "o", "c")}, {_copy("concat(o, '[*]')", "c")}), null)
  when 'store_at' then if(k = 'o', array({_row("write", "b", "o", "c")}), null)
  when 'read' then if(k = 'k', array({_copy("concat(b, '[', x, ']')", "c")}), null)
  when 'write' then if(k = 'k', array({_copy("c", "concat(b, '[', x, ']')")}, {_copy("c", "concat(b, '[]')")}), null)
  when 'iter' then case k when 'o' then array({_copy("concat(o, '[]')", "b")}) when 'g' then array({_copy("concat(x, '.<yield>')", "b")}) end
  when 'call' then case k
    when 'f' then array({_INVOKE.format(0)})
    when 'b' then array({_INVOKE.format(1)})
    when 'c' then array({_row("P", "b", "concat('i:', x)")}, {_row("L", "x", "''", "'__init__'", "concat(b, '<init>')", "concat('i:', x)")})
    when 'i' then array({_row("L", "x", "''", "'__call__'", "concat(b, '<call>')", "o")})
    when 'x' then if(n = 1 or x like '<%', array({_row("E", "c", "x")}), array({_row("E", "c", "x")}, {_row("P", "b", "o")})) end
  when 'super' then if(k = 'i', array({_row("P", "c", "concat('s:', b, '>', x)")}), null)
  when 'fill' then if(k = 'o', array({_FILLED}), null)
  when 'merge' then if(k = 'o', array({_row("into", "b", "o")}), null)
  when 'into' then if(k = 'o', array({_copy("concat(o, '[]')", "concat(b, '[*]')")}, {_copy("concat(o, '[]')", "concat(b, '[]')")}), null)
  when 'shift' then if(k = 'o', array({_row("SH", "o", "b", "cast(n as string)")}, {_copy("concat(o, '[*]')", "concat(b, '[*]')")}, {_copy("concat(o, '[]')", "concat(b, '[]')")}), null)
end"""


def _uses(facts: DataFrame) -> DataFrame:
    """(project, slot, u, b, c, n): what the sources do with the objects of places."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    plain = facts.filter(F.col("kind").isin(*_USES)).select("project", F.col("a").alias("slot"), F.col("kind").alias("u"), text("b"), text("c"), F.coalesce("n", F.lit(0)).alias("n"))
    calls, loops = plain.filter("u = 'call'"), plain.filter("u = 'iter'")
    made = calls.select("project", F.concat("b", F.lit("<init>")).alias("slot"), "u", "b", "c", F.lit(1).alias("n")).union(calls.select("project", F.concat("b", F.lit("<call>")), "u", "b", "c", F.lit(0)))
    step = lambda a, u, b, c: loops.select("project", a.alias("slot"), F.lit(u).alias("u"), b.alias("b"), c.alias("c"), F.lit(0).alias("n"))
    dst = lambda s: F.concat("b", F.lit(s))
    for a, u, b, c in (
        (F.col("slot"), "load_i", F.lit("__iter__"), dst("<iter>")), (dst("<iter>"), "call", dst("<iterator>"), F.col("c")), (dst("<iterator>"), "load_i", F.lit("__next__"), dst("<next>")), (dst("<next>"), "call", F.col("b"), F.col("c")),
        (dst("<iterator>"), "iter", F.col("b"), F.col("c")),
    ):
        made = made.union(step(a, u, b, c))
    items = plain.filter("u = 'copy' and b like 'o:%]'")
    anyone = items.select("project", "slot", "u", F.regexp_replace("b", r"\[[^\[]*\]$", "[]"), "c", "n")
    star = facts.filter("kind = 'star'").select("project", F.col("a").alias("module"), F.col("b").alias("scope")).join(facts.filter("kind = 'name' and b not like '\\\\_%'").select("project", F.col("a").alias("module"), F.col("b").alias("name")), ["project", "module"])
    starred = star.select("project", F.concat_ws(".", "module", "name"), F.lit("copy"), F.concat_ws(".", "scope", "name"), F.lit(""), F.lit(0))
    return plain.union(made).union(anyone).union(starred)


def _met(table: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table that are asked for, so that few of them go on to an outer join."""
    return table.join(asked.select(keys), keys, "left_semi")


def _solve(facts: DataFrame, uses: DataFrame, lookup: DataFrame, outside: DataFrame) -> DataFrame:
    """All rows of the fixpoint."""
    of = lambda kind: facts.filter(F.col("kind") == kind)
    known = written(of("module").select("project", F.col("a").alias("module")).distinct())
    like = written(of("like").select("project", F.col("a").alias("o"), F.col("b").alias("like")))
    first = of("param").filter("n = 0").select("project", F.col("a").alias("f"), F.col("c").alias("self"))
    functions = written(of("function").select("project", F.col("a").alias("f"), F.col("b").alias("how")).join(first, ["project", "f"], "left"))
    args = written(of("arg").select("project", F.col("a").alias("site"), F.col("b").alias("named"), F.col("c").alias("given"), F.col("n").alias("at")))
    params = written(of("param").select("project", F.col("a").alias("f"), F.col("b").alias("name"), F.col("c").alias("slot"), "n"))
    rest = written(of("rest").select("project", F.col("a").alias("f"), F.col("b").alias("o"), "n"))
    items = written(of("copy").filter(r"b rlike '^o:.*\\[[0-9]+\\]$'").select("project", F.regexp_extract("b", r"^(.*)\[[0-9]+\]$", 1).alias("o"), F.regexp_extract("b", r"\[([0-9]+)\]$", 1).cast("int").alias("at")))
    static = written(uses)
    objects = of("pts").select("project", F.lit("P").alias("kind"), "a", "b")
    made = of("yields").select("project", F.lit("P"), F.concat("a", F.lit(".<generator>")), F.concat(F.lit("g:"), "a")).distinct()
    seed = objects.union(made).select("*", *(F.lit("").alias(c) for c in "cde"))

    def held(rows: DataFrame) -> DataFrame:
        return rows.filter("kind = 'P'").select("project", F.col("a").alias("slot"), F.col("b").alias("o"))

    def used(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("kind").isin(*_DYNAMIC)).select("project", F.col("a").alias("slot"), F.col("kind").alias("u"), "b", "c", F.lit(0).alias("n"))

    def step(delta: DataFrame, every: DataFrame) -> DataFrame:
        met = held(delta).join(static.union(used(every)), ["project", "slot"]).unionByName(held(every).join(used(delta), ["project", "slot"]))
        split = met.select("project", "o", F.substring("o", 1, 1).alias("k"), F.expr("substring(o, 3)").alias("x"), "u", "b", "c", "n")
        given = written(split.select("project", F.explode(F.expr(_GIVES)).alias("g")).select("project", "g.*").distinct())
        many = {r["kind"]: r["count"] for r in given.groupBy("kind").count().collect()}  # only joins with rows are planned
        kind = lambda k: brief(given.filter(F.col("kind") == k), many[k] <= FEW)
        row = lambda kind, *parts: ["project", F.lit(kind).alias("kind"), *(p.alias(c) for p, c in zip([*parts, *[F.lit("")] * (5 - len(parts))], "abcde", strict=True))]
        out = [given.filter(F.col("kind").isin("P", "E", *_DYNAMIC))]
        if "ML" in many:
            asked = kind("ML").withColumn("inner", F.concat_ws(".", "a", "b"))
            inner, whole = known.select("project", F.col("module").alias("inner"), F.lit(True).alias("is_inner")), known.select("project", F.col("module").alias("a"), F.lit(True).alias("is_known"))
            module = asked.join(_met(inner, asked, ["project", "inner"]), ["project", "inner"], "left").join(_met(whole, asked, ["project", "a"]), ["project", "a"], "left")
            object_ = F.concat(F.when(F.col("is_inner"), "m:").when(F.col("is_known").isNull(), "x:"), "inner")
            got = F.array_compact(F.array(F.when(object_.isNotNull(), F.struct(*row("P", F.col("c"), object_)[1:])), F.when(F.col("is_known"), F.struct(*row("copy", F.col("inner"), F.col("c"))[1:]))))
            out.append(module.select("project", F.explode(got).alias("g")).select("project", "g.*"))
        if "L" in many:
            asked = kind("L").withColumnsRenamed({"a": "cls", "b": "after", "c": "attr"})
            sought = asked.join(_met(lookup, asked, ["project", "cls", "after", "attr"]), ["project", "cls", "after", "attr"], "left").join(_met(outside, asked, ["project", "cls"]), ["project", "cls"], "left")
            bind, above = row("bind", F.concat_ws(".", "definer", "attr"), F.col("d"), F.col("e")), row("P", F.col("d"), F.concat(F.lit("x:"), "beyond", F.lit("."), "attr"))
            got = F.when(F.col("definer").isNotNull(), F.struct(*bind[1:])).when(F.col("beyond").isNotNull(), F.struct(*above[1:]))
            out.append(sought.select("project", got.alias("g")).filter("g is not null").select("project", "g.*"))
        if "LK" in many:
            out.append(kind("LK").withColumnRenamed("a", "o").join(like, ["project", "o"]).select(*row("P", F.col("c"), F.concat(F.lit("x:"), "like", F.lit("."), "b"))))
        if "BF" in many:
            bound = kind("BF").withColumnRenamed("a", "f").join(functions, ["project", "f"]).withColumn("self_bound", F.expr("how = 'class' or how = 'plain' and c like 'i:%'"))
            itself = row("P", F.col("self"), F.when(F.col("how") == "class", F.concat(F.lit("c:"), F.expr("substring(c, 3)"))).otherwise(F.col("c")))
            got = F.array(F.struct(*row("P", F.col("b"), F.concat(F.when(F.col("self_bound"), "b:").otherwise("f:"), "f"))[1:]), F.when(F.expr("self_bound and self is not null"), F.struct(*itself[1:])))
            out.append(bound.select("project", F.explode(F.array_compact(got)).alias("g")).select("project", "g.*"))
        if "T" in many:
            sent = kind("T").select("project", F.col("a").alias("site"), F.col("b").alias("f"), F.col("c").cast("int").alias("off")).join(args, ["project", "site"])
            fits = (F.col("n") == F.col("at") + F.col("off")) | (F.col("name") == F.col("named"))
            out.append(sent.join(params, ["project", "f"]).filter(fits).select(*row("copy", F.col("given"), F.col("slot"))))
            over = sent.join(rest, ["project", "f"]).filter("at + off >= n")
            one = F.concat("o", F.lit("["), (F.col("at") + F.col("off") - F.col("n")).cast("string"), F.lit("]"))
            out.append(over.select("*", F.explode(F.array(one, F.concat("o", F.lit("[]")))).alias("to")).select(*row("copy", F.col("given"), F.col("to"))))
        if "SH" in many:
            moved = kind("SH").withColumnRenamed("a", "o").join(items, ["project", "o"]).filter("at >= int(c)")
            out.append(moved.select(*row("copy", F.concat("o", F.lit("["), F.col("at").cast("string"), F.lit("]")), F.concat("b", F.lit("["), (F.col("at") - F.col("c").cast("int")).cast("string"), F.lit("]")))))
        every_row = out[0].select(_COLUMNS)
        for part in out[1:]:
            every_row = every_row.union(part.select(_COLUMNS))
        return every_row

    return fixpoint(seed.select(_COLUMNS), step)[0]


@F.pandas_udf(ArrayType(StringType()))
def _merged(frame: pd.DataFrame) -> pd.Series:
    """C3 linearization of a class from its bases' ones; where there is none, depth first without repeats."""
    return pd.Series([_c3(name, [list(m) for m in orders], list(bases)) for name, orders, bases in zip(frame.iloc[:, 0], frame.iloc[:, 1], frame.iloc[:, 2], strict=True)])


def _c3(name: str, orders: list[list[str]], bases: list[str]) -> list[str]:
    todo, out = [list(o) for o in [*orders, bases]], [name]
    while any(todo):
        todo = [o for o in todo if o]
        head = next((o[0] for o in todo if not any(o[0] in p[1:] for p in todo)), None)
        if head is None:
            return list(dict.fromkeys([name, *(x for o in orders for x in o)]))
        out.append(head)
        todo = [o[1:] if o[0] == head else o for o in todo]
    return out


def method_order(bases: DataFrame) -> DataFrame:
    """(project, cls, mro) for classes with their bases in order, (project, cls, bases); a class on a cycle has only itself."""
    left, done = written(bases), None
    while not left.isEmpty():
        asked = left.select("project", "cls", "bases", F.posexplode_outer("bases").alias("k", "base"))
        if done is None:
            known = asked.withColumn("got", F.when(F.col("base").like("x:%") | F.col("base").isNull(), F.array("base")))
        else:
            known = asked.join(done.select("project", F.concat(F.lit("c:"), "cls").alias("base"), "mro"), ["project", "base"], "left").withColumn("got", F.when(F.col("base").like("x:%") | F.col("base").isNull(), F.array("base")).otherwise(F.col("mro")))
        full = known.groupBy("project", "cls", "bases").agg(F.every(F.col("got").isNotNull()).alias("ready"), F.transform(F.array_sort(F.collect_list(F.struct("k", "got"))), lambda s: s["got"]).alias("orders"))
        orders = F.when(F.size("bases") > 0, F.col("orders")).otherwise(F.array().cast("array<array<string>>"))
        ready = written(full.filter("ready").select("project", "cls", _merged(F.struct(F.concat(F.lit("c:"), "cls"), orders, "bases")).alias("mro")))
        if ready.isEmpty():
            ready = written(left.select("project", "cls", F.array(F.concat(F.lit("c:"), "cls")).alias("mro")))
        done = ready if done is None else written(done.union(ready))
        left = written(left.join(ready, ["project", "cls"], "left_anti"))
    return done if done is not None else bases.select("project", "cls", F.col("bases").alias("mro"))


def _members(facts: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project, cls, after, attr, definer): the first class with an attribute, of all or those after one; (project, cls, beyond): the first base from outside."""
    places = order.select("project", "cls", F.posexplode("mro").alias("at", "anc"))
    member = facts.filter("kind = 'member'").select("project", F.concat(F.lit("c:"), "a").alias("anc"), F.col("b").alias("attr"))
    has = places.join(member, ["project", "anc"])
    begins = places.select("project", "cls", F.col("at").alias("begin"), F.expr("substring(anc, 3)").alias("after")).union(order.select("project", "cls", F.lit(-1), F.lit("")))
    found = has.join(begins, ["project", "cls"]).filter("at > begin").groupBy("project", "cls", "after", "attr").agg(F.min(F.struct("at", "anc")).alias("f"))
    beyond = places.filter("anc like 'x:%'").groupBy("project", "cls").agg(F.min(F.struct("at", "anc")).alias("f")).select("project", "cls", F.expr("substring(f.anc, 3)").alias("beyond"))
    return found.select("project", "cls", "after", "attr", F.expr("substring(f.anc, 3)").alias("definer")), beyond


def call_graph(facts: DataFrame) -> DataFrame:
    """(project, caller, callee) of facts from ``flow_facts``: functions, methods, what is called from outside and builtins."""
    facts = written(facts)
    uses = _uses(facts)
    spark = facts.sparkSession
    none = spark.createDataFrame([], "project string, cls string, after string, attr string, definer string"), spark.createDataFrame([], "project string, cls string, beyond string")
    before = _solve(facts, uses.filter("u in ('copy', 'load')"), *none).filter("kind = 'P'")
    based = facts.filter("kind = 'base'").select("project", F.col("a").alias("cls"), F.col("b").alias("slot"), F.col("n").alias("k"))
    held = before.select("project", F.col("a").alias("slot"), F.col("b").alias("base")).filter("base like 'c:%' or base like 'x:%' and base not like 'x:<%'")
    listed = based.join(held, ["project", "slot"]).groupBy("project", "cls").agg(F.array_sort(F.collect_set(F.struct("k", "base"))).alias("b"))
    bases = facts.filter("kind = 'class'").select("project", F.col("a").alias("cls")).distinct().join(listed, ["project", "cls"], "left")
    order = written(method_order(bases.select("project", "cls", F.coalesce(F.array_distinct("b.base"), F.array().cast("array<string>")).alias("bases"))))
    lookup, outside = (written(x) for x in _members(facts, order))
    return _solve(facts, uses, lookup, outside).filter("kind = 'E'").select("project", F.col("a").alias("caller"), F.col("b").alias("callee"))


def file_calls(files: DataFrame) -> DataFrame:
    """(project, caller, callee) of files (project, path, text): projects with equal files are parsed and worked out once."""
    files = files.withColumn("project", F.col("project").cast("string"))
    members, _ = alike.classes(files.select("project", "path", F.sha2("text", 256).alias("text")), "project", "path", "text")
    likes = members.filter("project = like").select("project")
    return alike.given(call_graph(flows.flow_facts(files.join(likes, "project"))), members, "project").select("project", "caller", "callee")


def graph_nodes(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, node): functions and modules of the sources and all that is called."""
    return facts.filter("kind in ('function', 'module')").select("project", F.col("a").alias("node")).union(edges.select("project", "callee")).distinct()
