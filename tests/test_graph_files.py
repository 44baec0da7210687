"""Graph files of every format, and a folder followed over restarts."""

from pathlib import Path

from factweave.sources import graphs
from factweave.streaming import runs


def test_formats(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("a.txt", "# edges\n1 2\n2 1\n2 3 0.5\n3 3\n\nlonely\n")
    write("b.txt", "1: 2 3\n2: 1, 3\n4:\n")
    write("c.txt", "c comment\np edge 3 2\ne 1 2\ne 3 2\n")
    write("d.txt", ">>graph6<<\nC~\nBg\n@\n")  # the complete graph of four, a path of three, one vertex
    write("e.xml", '<?xml version="1.0"?>\n<graphml><graph edgedefault="undirected"><node id="x"/><node id="y"/>\n<edge source="y"\n target="x"/></graph></graphml>\n')
    write("f.txt", "\n\n")
    got = {}
    for r in graphs.read_graphs(spark, str(tmp_path)).collect():
        got.setdefault((Path(r.file).name, r.format, r.graph), set()).add((r.src, r.dst))
    assert got == {
        ("a.txt", "edges", ""): {("1", "2"), ("2", "3")}, ("b.txt", "adjacency", ""): {("1", "2"), ("1", "3"), ("2", "3")}, ("c.txt", "dimacs", ""): {("1", "2"), ("2", "3")},
        ("d.txt", "graph6", "C~"): {(str(a), str(b)) for b in range(4) for a in range(b)}, ("d.txt", "graph6", "Bg"): {("0", "1"), ("1", "2")}, ("e.xml", "graphml", ""): {("x", "y")},
    }


def test_wide_graph6(spark, tmp_path):
    """A path of 70 vertices: its size takes the tilde and three bytes."""
    n = 70
    bits = [int(a + 1 == b) for b in range(n) for a in range(b)]
    bits += [0] * (-len(bits) % 6)
    line = "~" + "".join(chr(63 + (n >> s & 63)) for s in (12, 6, 0)) + "".join(chr(63 + int("".join(map(str, bits[k : k + 6])), 2)) for k in range(0, len(bits), 6))
    (tmp_path / "g.g6").write_text(f">>graph6<<{line}\n")
    assert {(int(r.src), int(r.dst)) for r in graphs.graph6_edges(graphs._lines(spark, str(tmp_path))).collect()} == {(k, k + 1) for k in range(n - 1)}


def test_ingestion_restarts(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for lo, hi in ((0, 10), (5, 20), (20, 20), (18, 30)):
        spark.range(lo, hi).withColumnRenamed("id", "k").write.mode("append").parquet(inbox)
        runs.ingest(spark, inbox, "k long", out, mark, ["k"])
        runs.ingest(spark, inbox, "k long", out, mark, ["k"])  # nothing new
        assert sorted(r.k for r in spark.read.schema("k long").parquet(out).collect()) == list(range(hi))
