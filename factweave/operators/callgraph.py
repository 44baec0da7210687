"""Call graphs from syntax facts, and their text, DOT and JSON forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What call graphs read of syntax nodes: kinds and columns.
KINDS = ("FunctionDef", "AsyncFunctionDef", "Name", "Module")
COLUMNS = ("file_id", "kind", "field", "name", "qualname", "scope")


def call_graph(nodes: DataFrame) -> DataFrame:
    """(file_id, caller, callee): calls by plain name of functions defined in the same file.

    Callers are ``main`` or a function's qualified name; a nested function's calls count for the enclosing ones too.
    Callees are the qualified names of the functions with that name.
    """
    defined = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef')").select("file_id", "name", F.col("qualname").alias("callee"))
    plain = nodes.filter("kind = 'Name' and field = 'func'").select("file_id", "name", "scope")  # not of attributes
    parts = F.split("scope", r"\.")
    enclosing = plain.withColumn("caller", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).otherwise(F.array(F.lit("main")))))
    return enclosing.join(defined, ["file_id", "name"]).select("file_id", "caller", "callee").distinct()


def adjacency(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(file_id, caller, callees): every member (file_id, caller), with sorted callees, empty for none."""
    got = edges.groupBy("file_id", "caller").agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    return members.select("file_id", "caller").distinct().join(got, ["file_id", "caller"], "left").withColumn("callees", F.coalesce("callees", F.array().cast("array<string>")))


def as_text(graph: DataFrame) -> DataFrame:
    shown = F.when(F.size("callees") > 0, F.array_join("callees", ", ")).otherwise("(no calls)")
    return graph.select("file_id", F.concat("caller", F.lit(" -> "), shown).alias("line"))


def as_dot(graph: DataFrame) -> DataFrame:
    """Lines of a DOT graph body."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    node = graph.select("file_id", F.concat(quote(F.col("caller")), F.lit(";")).alias("line"))
    edge = graph.select("file_id", "caller", F.explode("callees").alias("callee")).select("file_id", F.concat(quote(F.col("caller")), F.lit(" -> "), quote(F.col("callee")), F.lit(";")).alias("line"))
    return node.union(edge)


def as_json(graph: DataFrame) -> DataFrame:
    """(file_id, json): functions and invocations of each file."""
    return graph.groupBy("file_id").agg(F.to_json(F.struct(F.array_sort(F.collect_set("caller")).alias("functions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("caller", "callees")))).alias("invocations"))).alias("json"))
