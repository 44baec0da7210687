"""Queries over the functions of the source files that ``programs.files`` writes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow
from .base import query
from .programs import files

# g_k: entry 0 -> 2 (empty) -> switch 3 -> 4 (true), 5 (false) -> merge 6 -> exit 1; f_k: entry 0 -> 2 -> exit 1
_G, _F = "'main.g_' || p_partkey", "'main.f_' || p_partkey"
_EDGES = "(0, 2, 'entry'), (2, 3, 'normal'), (3, 4, 'true'), (3, 5, 'false'), (4, 6, 'normal'), (5, 6, 'normal'), (6, 1, 'return')"


def _both(values_g: str, values_f: str, columns: str) -> str:
    return f"SELECT p_partkey AS file_id, {_G} AS func, v.* FROM part, (VALUES {values_g}) v({columns}) UNION ALL SELECT p_partkey, {_F}, v.* FROM part, (VALUES {values_f}) v({columns})"


@query("flw01", _both(_EDGES, "(0, 2, 'entry'), (2, 1, 'return')", "src, dst, label"))
def control_flow(spark, sf_dir):
    return flow.edges(files(spark, sf_dir))


@query("flw02", _both("(0, 'entry'), (1, 'exit'), (2, 'suite'), (3, 'switch'), (4, 'suite'), (5, 'suite'), (6, 'merge')", "(0, 'entry'), (1, 'exit'), (2, 'suite')", "block, kind"))
def block_model(spark, sf_dir):
    return flow.blocks(files(spark, sf_dir)).drop("code")


@query("flw11", _both("(0, 0), (2, 0), (2, 2), (3, 0), (3, 2), (3, 3), (4, 0), (4, 2), (4, 3), (4, 4), (5, 0), (5, 2), (5, 3), (5, 5), (6, 0), (6, 2), (6, 3), (6, 6), (1, 0), (1, 2), (1, 3), (1, 6), (1, 1)", "(0, 0), (2, 0), (2, 2), (1, 0), (1, 2), (1, 1)", "node, dom"))
def dominance(spark, sf_dir):
    return flow.dominance(files(spark, sf_dir))


_CDG = f"SELECT p_partkey AS file_id, {_G} AS func, v.* FROM part, (VALUES (3, 4, 'true'), (3, 5, 'false')) v(src, dst, label)"


@query("cdg01", _CDG)
def control_dependence(spark, sf_dir):
    return flow.control(files(spark, sf_dir))


@query("cdg02", f"SELECT file_id, func, dst FROM ({_CDG}) WHERE src = 3")
def control_dependents(spark, sf_dir):
    return flow.control(files(spark, sf_dir)).filter("src = 3").select("file_id", "func", "dst")


@query("agg15", f"SELECT file_id, func, count(*) AS edges, count(DISTINCT src) AS controllers, count(CASE WHEN label = 'true' THEN 1 END) AS when_true FROM ({_CDG}) GROUP BY ALL")
def control_statistics(spark, sf_dir):
    return flow.control(files(spark, sf_dir)).groupBy("file_id", "func").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("controllers"), F.count_if(F.col("label") == "true").alias("when_true"))


@query("snk10", f"SELECT file_id, func, src || ' -> ' || dst || ' [' || label || ']' AS line FROM ({_CDG})")
def control_text(spark, sf_dir):
    return flow.control(files(spark, sf_dir)).select("file_id", "func", F.format_string("%d -> %d [%s]", "src", "dst", "label").alias("line"))


@query("snk09", f"SELECT file_id, func, src || ' -> ' || dst || ' [label=\"' || label || '\"];' AS line FROM ({_both(_EDGES, '(0, 2, $$entry$$), (2, 1, $$return$$)', 'src, dst, label')})")
def flow_dot(spark, sf_dir):
    return flow.edges(files(spark, sf_dir)).select("file_id", "func", F.format_string('%d -> %d [label="%s"];', "src", "dst", "label").alias("line"))


@query("snk08", f"SELECT file_id, func, dst AS block, string_agg(CAST(src AS VARCHAR), ' ' ORDER BY src) AS preds FROM ({_both(_EDGES, '(0, 2, $$entry$$), (2, 1, $$return$$)', 'src, dst, label')}) GROUP BY ALL")
def flow_text(spark, sf_dir):
    e = flow.edges(files(spark, sf_dir))
    return e.groupBy("file_id", "func", F.col("dst").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), " ").alias("preds"))


@query("flw13", f"SELECT p_partkey AS file_id, {_G} AS func, 0 AS src, unnest([3, 4, 6]) AS dst, 'b' AS var FROM part UNION ALL SELECT p_partkey, {_F}, 0, 2, 'a' FROM part")
def read_modify(spark, sf_dir):
    return flow.data(files(spark, sf_dir))


@query("snk11", f"SELECT p_partkey AS file_id, {_F} AS func, '0 -> 2 [a]' AS line FROM part")
def data_text(spark, sf_dir):
    d = flow.data(files(spark, sf_dir)).filter("var = 'a'")
    return d.select("file_id", "func", F.format_string("%d -> %d [%s]", "src", "dst", "var").alias("line"))
