"""Files that are written from the tables and read back: graph formats, and a folder that fills while a stream follows it."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources import graphs
from ..streaming import runs
from . import structure
from .base import query, table


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_graphs(e, folder):
    """Edges (graph, src, dst) with small vertex numbers in five formats, under a folder for each."""
    named = e.select(F.concat_ws(".", "graph", "src").alias("a"), F.concat_ws(".", "graph", "dst").alias("b"))
    named.select(F.concat_ws(" ", "a", "b")).write.text(f"{folder}/edges")
    named.groupBy("a").agg(F.concat(F.col("a"), F.lit(": "), F.array_join(F.collect_set("b"), " ")).alias("line")).select("line").write.text(f"{folder}/adjacency")
    named.select(F.concat(F.lit("e "), "a", F.lit(" "), "b").alias("line")).union(e.sparkSession.range(64).select(F.lit("p edge 1 1"))).repartition(4).write.text(f"{folder}/dimacs")
    bit = F.col("dst") * (F.col("dst") - 1) / 2 + F.col("src")  # of the upper triangle
    bits = e.groupBy("graph").agg(F.collect_set(bit.cast("int")).alias("on"))
    byte = lambda k: F.expr(f"char(63 + {' + '.join(f'if(array_contains(on, {6 * k + i}), {1 << (5 - i)}, 0)' for i in range(6))})")
    line = F.concat(F.lit(">>graph6<<"), F.lit(chr(63 + 8)), *(byte(k) for k in range(5)))  # eight vertices have 28 pairs
    bits.select(line.alias("line")).write.text(f"{folder}/graph6")

    def documents(it):  # one for each part file
        yield pa.RecordBatch.from_pydict({"line": ['<graphml><graph edgedefault="undirected">']})
        for batch in it:
            yield pa.RecordBatch.from_pydict({"line": [f'<edge source="{a}" target="{b}"/>' for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]})
        yield pa.RecordBatch.from_pydict({"line": ["</graph></graphml>"]})

    named.mapInArrow(documents, "line string").write.text(f"{folder}/graphml")


@query("src13", f"""WITH {structure._LINES}, n AS (SELECT DISTINCT p || '.' || j AS a, p || '.' || k AS b FROM e)
SELECT f AS format, least(a, b) AS src, greatest(a, b) AS dst FROM n, (SELECT unnest(['edges', 'adjacency', 'dimacs', 'graphml']) AS f)
UNION ALL SELECT DISTINCT 'graph6', CAST(least(j, k) AS VARCHAR), CAST(greatest(j, k) AS VARCHAR) FROM e""")
def graph_files(spark, sf_dir):
    """The edges of all orders' programs, written in five formats and read back."""
    folder = _folder(spark, "graphs")
    write_graphs(structure.edges(structure.lines(spark, sf_dir)), folder)
    return graphs.read_graphs(spark, folder).select("format", "src", "dst").distinct()


@query("str05", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def ingested(spark, sf_dir):
    """Events that arrive in three batches, the second with all of the first again; a stream takes each in a run of its own."""
    events = table(spark, sf_dir, "events")
    inbox, out, checkpoint = (_folder(spark, x) for x in ("inbox", "events", "checkpoint"))
    batch = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for arrived in ([0], [0, 1], [2]):
        events.filter(batch.isin(*arrived)).write.mode("append").parquet(inbox)
        runs.ingest(spark, inbox, events._jdf.schema().toDDL(), out, checkpoint, ["event_id"])
    return spark.read.schema(events.schema).parquet(out).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
