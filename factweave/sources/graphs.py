"""Undirected graphs from text files: edge lists, adjacency lists, DIMACS, graph6 and GraphML, told apart by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written

#: What lines of a format look like, in the order in which formats are tried.
MARKS = {"graphml": r"<graphml\b", "graph6": r"^>>graph6<<", "dimacs": r"^p\s+(edge|col)\s", "adjacency": r"^\s*[^\s:#]+\s*:"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).filter("line <> ''")


def formats(spark: SparkSession, path: str) -> DataFrame:
    """(file, format) of all files under a path: the first format of which a file has a line, else an edge list."""
    seen = _lines(spark, path).groupBy("file").agg(*(F.bool_or(F.col("line").rlike(mark)).alias(name) for name, mark in MARKS.items()))
    found = F.coalesce(*(F.when(F.col(name), name) for name in MARKS), F.lit("edges"))
    return seen.select("file", found.alias("format"))


def _size(line: Column) -> tuple[Column, Column]:
    """Vertices of a graph6 line, and where its bits begin: one byte, or three behind a tilde."""
    at = lambda k: F.ascii(F.substring(line, k, 1)) - 63
    wide = F.substring(line, 1, 1) == "~"
    return F.when(wide, F.shiftleft(at(2), 12) + F.shiftleft(at(3), 6) + at(4)).otherwise(at(1)), F.when(wide, 5).otherwise(2)


def graph6_edges(lines: DataFrame) -> DataFrame:
    """(file, graph, src, dst) of graph6 lines (file, line): bit k of the upper triangle, column by column, six bits a byte; vertices count from 0."""
    n, begin = _size(F.col("line"))
    sized = lines.select("file", F.regexp_replace("line", "^>>graph6<<", "").alias("line")).filter("line <> ''").select("file", "line", n.alias("n"), begin.alias("begin")).filter("n > 1")
    bits = sized.withColumn("k", F.explode(F.expr("sequence(0L, cast(n as bigint) * (n - 1) div 2 - 1)")))
    on = bits.filter(F.expr("(ascii(substring(line, cast(begin + k div 6 as int), 1)) - 63) & cast(shiftleft(1, cast(5 - k % 6 as int)) as int) <> 0"))
    j = F.floor((F.sqrt(8 * F.col("k") + 1) + 1) / 2)
    return on.withColumn("j", j).select("file", F.col("line").alias("graph"), (F.col("k") - F.expr("j * (j - 1) div 2")).cast("string").alias("src"), F.col("j").cast("string").alias("dst"))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, graph, src, dst): each undirected edge once, its ends in order; ``graph`` is the line of a graph6 graph, else empty.

    Lines are read in splits, so that one large file is read by many tasks; only GraphML goes through the XML source, by
    file name. Comments begin with ``#`` or ``c``; loops and repeated edges are left out; lines of no edge are skipped.
    """
    kinds = written(formats(spark, path))
    lines = _lines(spark, path).join(kinds, "file")
    of = lambda name: lines.filter(F.col("format") == name).select("file", "line")
    word = F.split("line", r"\s+")
    plain = lambda frame, a, b: frame.select("file", F.lit("").alias("graph"), a.alias("src"), b.alias("dst"))
    edges = plain(of("edges").filter("line not like '#%'").filter(F.size(word) >= 2), word[0], word[1])
    dimacs = plain(of("dimacs").filter("line like 'e %'").filter(F.size(word) >= 3), word[1], word[2])
    near = of("adjacency").filter("line not like '#%'").select("file", F.trim(F.substring_index("line", ":", 1)).alias("a"), F.explode(F.split(F.trim(F.regexp_extract("line", r":(.*)$", 1)), r"[\s,]+")).alias("b")).filter("b <> ''")
    found = edges.unionByName(dimacs).unionByName(plain(near, F.col("a"), F.col("b"))).unionByName(graph6_edges(of("graph6")))
    names = [r["file"] for r in kinds.filter("format = 'graphml'").select("file").collect()]  # file names, as many as the scan's own listing
    if names:
        xml = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(names).select(F.col("_metadata.file_path").alias("file"), "_source", "_target")
        found = found.unionByName(plain(xml, F.col("_source"), F.col("_target")))
    once = found.filter("src <> dst").select("file", "graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return once.join(kinds, "file").select("file", "format", "graph", "src", "dst")
