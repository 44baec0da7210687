"""Registration of queries and the facts that they derive from the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(lineitem: DataFrame) -> DataFrame:
    """(p, j, flag, status, weight, next, after, first, last): each line of an order once, with the numbers of the next two and of the order's ends."""
    one = lineitem.groupBy(F.col("l_orderkey").alias("p"), F.col("l_linenumber").alias("j")).agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.max("l_quantity").cast("long").alias("weight"))
    w, whole = Window.partitionBy("p").orderBy("j"), Window.partitionBy("p")
    return one.select("*", F.lead("j").over(w).alias("next"), F.lead("j", 2).over(w).alias("after"), F.min("j").over(whole).alias("first"), F.max("j").over(whole).alias("last"))


def led() -> Column:
    """A row for each line that one of ``lines`` leads to, its number as ``to``."""
    to = [("next", "next is not null and (flag <> 'A' or after is null)"), ("after", "after is not null and flag <> 'N'"), ("first", "j = last and j > first and status = 'F'")]
    return F.explode(F.array_compact(F.array(*(F.when(F.expr(where), F.col(c)) for c, where in to)))).alias("to")


def program(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, flow) of the programs that orders describe, one graph for each order, from all lines.

    nodes (id, top, bottom, region): a line's id is ten times its order's number and its own; the first is top, the last bottom.
    flow (src, dst, weight, kind): a line leads to the next one, some (R) also to the one after it, others (A) only there; the last
    line of some orders leads back to the first.
    """
    l, at = written(lines(table(spark, sf_dir, "lineitem"))), lambda j: (F.col("p") * 10 + F.col(j)).cast("long")
    kind = F.when(F.col("flag") == "R", "3-MEDIUM").when(F.col("flag") == "N", F.when(F.col("status") == "O", "1-URGENT").otherwise("2-HIGH")).otherwise(F.when(F.col("status") == "O", "4-NOT SPECIFIED").otherwise("5-LOW"))
    f = l.select("p", "j", "weight", kind.alias("kind"), led()).select(at("j").alias("src"), at("to").alias("dst"), "weight", "kind")
    return l.select(at("j").alias("id"), (F.col("j") == F.col("first")).alias("top"), (F.col("j") == F.col("last")).alias("bottom"), F.when(F.col("status") == "F", 0).otherwise(1).alias("region")), f


#: ``program`` in SQL, as common table expressions.
FLOW = """line AS (SELECT *, lead(j) OVER w AS next, lead(j, 2) OVER w AS after, min(j) OVER (PARTITION BY p) AS first, max(j) OVER (PARTITION BY p) AS last
    FROM (SELECT l_orderkey AS p, l_linenumber AS j, max(l_returnflag) AS flag, max(l_linestatus) AS status, CAST(trunc(max(l_quantity)) AS BIGINT) AS weight FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY p ORDER BY j)),
  node AS (SELECT CAST(p * 10 + j AS BIGINT) AS id, j = first AS top, j = last AS bottom, CASE status WHEN 'F' THEN 0 ELSE 1 END AS region FROM line),
  flow AS (SELECT CAST(p * 10 + j AS BIGINT) AS src, CAST(p * 10 + k AS BIGINT) AS dst, weight, CASE WHEN flag = 'R' THEN '3-MEDIUM' WHEN flag = 'N' AND status = 'O' THEN '1-URGENT' WHEN flag = 'N' THEN '2-HIGH' WHEN status = 'O' THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS kind FROM (
    SELECT *, next AS k FROM line WHERE next IS NOT NULL AND (flag <> 'A' OR after IS NULL) UNION ALL SELECT *, after FROM line WHERE after IS NOT NULL AND flag <> 'N' UNION ALL SELECT *, first FROM line WHERE j = last AND j > first AND status = 'F'))"""

#: The edges of ``flow``.
EDGE = FLOW + """, edge AS (SELECT DISTINCT src, dst FROM flow)"""


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program(spark, sf_dir)[1]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program(spark, sf_dir)[0]


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): every order's first line."""
    return nodes(spark, sf_dir).filter("top").select(F.col("id").alias("node"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir).select("src", "dst").distinct()


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(op, ts, slot, mode): events as reads and writes of their user's slot; errors are neither."""
    mode = F.when(F.col("event_type").isin("purchase", "signup"), "write").when(F.col("event_type").isin("view", "click"), "read")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("op"), "ts", F.col("user_id").alias("slot"), mode.alias("mode")).filter("mode is not null")


OPERATIONS = """ops AS (SELECT event_id AS op, ts, user_id AS slot, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS mode
  FROM events WHERE event_type IN ('purchase', 'signup', 'view', 'click'))"""


def in_order(*keys: str):
    """Operations of a slot in time order, ties by id."""
    return Window.partitionBy(*keys).orderBy("ts", "op")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): regions, nations, customers."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t("region").select(name("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
        .union(t("nation").select(name("N", "n_nationkey"), name("R", "n_regionkey")))
        .union(t("customer").select(name("C", "c_custkey"), name("N", "c_nationkey")))
    )


TREE = """tree AS (SELECT 'R' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)"""
