"""Queries of passes, streams and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuzz, rules
from ..shared import written
from ..streaming import runs
from .base import query, table
from .passes import Engine, standard
from .programs import files


@query("udx05", "SELECT p_partkey AS file_id, 2 AS edges FROM part")
def scheduled(spark, sf_dir):
    """The call graph by the pass engine, which runs what it needs first."""
    return standard(Engine({"files": files(spark, sf_dir)})).run(["call_graph"])["call_graph"].groupBy("file_id").agg(F.count("*").cast("int").alias("edges"))


@query("udx06", "SELECT * FROM (VALUES (0, 'nodes'), (1, 'call_graph'), (2, 'control_flow'), (3, 'dominance'), (4, 'control_dependence')) t(position, name)")
def standard_passes(spark, sf_dir):
    order = standard(Engine()).order(["call_graph", "control_dependence"])
    return spark.createDataFrame(list(enumerate(order)), "position int, name string")


@query("udx01", "SELECT p_partkey AS file_id, 1 AS issues FROM part")
def custom_rule(spark, sf_dir):
    """A rule of one's own: no function may be named g_*."""
    from ..sources import python

    own = lambda nodes: rules._issue(nodes.filter("kind = 'FunctionDef' and name like 'g\\\\_%'"), "X001", "LOW", "HIGH", 0)
    return rules.run_rules(written(python.parse(files(spark, sf_dir), rules.KINDS, rules.COLUMNS)), [own]).filter("test_id = 'X001'").groupBy("file_id").agg(F.count("*").cast("int").alias("issues"))


@query("udx09", "SELECT p_partkey AS file_id, 'block' AS family, 3 AS n FROM part")
def dispatch(spark, sf_dir):
    """Node kinds by family, as a visitor with ancestor fallback would see them."""
    from ..sources import python

    family = spark.createDataFrame([("FunctionDef", "block"), ("If", "block"), ("While", "block")], "kind string, family string")
    return python.parse(files(spark, sf_dir), ("FunctionDef", "If", "While"), ("file_id", "kind")).join(F.broadcast(family), "kind").groupBy("file_id", "family").agg(F.count("*").cast("int").alias("n"))


@query("str04", "SELECT time_bucket(INTERVAL 5 SECOND, ts) AS start, event_type AS kind, count(*) AS n, max(value) AS best FROM events GROUP BY ALL")
def pulses(spark, sf_dir):
    """Events in five-second windows; the same function takes a stream."""
    return runs.pulses(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), "value"))


@query("snk18", "SELECT DISTINCT sha256(text) AS name, strlen(text) AS size FROM documents")
def artefacts(spark, sf_dir):
    """Artefacts named by content: one for each text."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("name"), F.octet_length("text").cast("long").alias("size"))
    return d.dropDuplicates(["name"])


@query("snk19", "SELECT sha256(text) AS name, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark) GROUP BY ALL")
def idempotent(spark, sf_dir):
    """What a second write would still have to write: texts whose hash is not there."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("name")).agg(F.min("doc_id").alias("doc_id"))
    return fuzz.only_new(d, table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("name"))).select("name", "doc_id")


@query("snk16", "SELECT n_name AS label, printf('%s & %d \\\\', n_name, count(*)) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def tables(spark, sf_dir):
    """Rows of a typeset table."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return c.join(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("n_name").alias("label"), F.format_string("%s & %d \\\\", "n_name", "n").alias("line"))


@query("src14", "SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT item_id FROM benchmark")
def baseline(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct().join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti")


@query("fuz01")
def mutated(spark, sf_dir):
    return fuzz.mutations(table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").cast("binary").alias("body"))).select("id", "round", "name")
