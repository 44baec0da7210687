"""Queries over source code that is written out from the parts table, one file for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import credential_name, cwe_link, escape_markup, module_name
from ..operators import callgraph, rules
from ..shared import written
from ..sources import python
from .base import query, table


def files(spark, sf_dir):
    """(file_id, path, text): what a part's file holds depends on its size and brand."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), "p_size", "p_brand", F.col("p_partkey").cast("string").alias("k"))
    even, small = F.col("p_size") % 2 == 0, F.col("p_size") < 10
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) and x != "k" else F.col("k") for x in parts])
    text = F.concat_ws(
        "\n", F.lit("import os"), F.when(even, "import pickle as pk").otherwise("from subprocess import Popen as run"), F.when(small, F.concat(F.lit('token = "'), "p_brand", F.lit('"'))).otherwise("limit = 1"),
        line("def g_", "k", "(b):"), F.lit("    if b:"), F.when(even, "        pk.loads(b)").otherwise("        run(b, shell=True)"), F.lit("    return b"), line("def f_", "k", "(a):"),
        F.when(small, "    exec(a)  # nosec").otherwise("    exec(a)"), line("    return g_", "k", "(a)"), line("f_", "k", "(limit)"),
    )
    return p.select("file_id", F.concat(F.lit("pkg/"), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("/m_"), "k", F.lit(".py")).alias("path"), text.alias("text"))


def nodes(spark, sf_dir, kinds=None, columns=None):
    return python.parse(files(spark, sf_dir), kinds, columns)


_ISSUES = """SELECT p_partkey AS file_id, lineno, test_id, severity, confidence, cwe FROM (
  SELECT p_partkey, 2 AS lineno, 'B403' AS test_id, 'LOW' AS severity, 'HIGH' AS confidence, 502 AS cwe FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 2, 'B404', 'LOW', 'HIGH', 78 FROM part WHERE p_size % 2 <> 0
  UNION ALL SELECT p_partkey, 3, 'B105', 'LOW', 'MEDIUM', 259 FROM part WHERE p_size < 10
  UNION ALL SELECT p_partkey, 6, 'B301', 'MEDIUM', 'HIGH', 502 FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 6, 'B602', 'HIGH', 'HIGH', 78 FROM part WHERE p_size % 2 <> 0
  UNION ALL SELECT p_partkey, 9, 'B102', 'MEDIUM', 'HIGH', 78 FROM part WHERE p_size >= 10)"""


def issues(spark, sf_dir):
    f = files(spark, sf_dir)
    return judged(f)[0]


def judged(f):
    """(kept, suppressed) issues of files, each file parsed and its comments read once."""
    return rules.suppressed(written(rules.run_rules(written(python.parse(f, rules.KINDS, rules.COLUMNS)))), written(python.suppressions(f)))


def _shown(i):
    return i.select("file_id", "lineno", "test_id", "severity", "confidence", "cwe")


@query("udx03", _ISSUES)
def rule_execution(spark, sf_dir):
    return _shown(issues(spark, sf_dir))


def _rule(name, *tests):
    listed = ", ".join(f"'{t}'" for t in tests)

    @query(name, f"SELECT * FROM ({_ISSUES}) WHERE test_id IN ({listed})")
    def one(spark, sf_dir):
        return _shown(issues(spark, sf_dir).filter(F.col("test_id").isin(*tests)))


for _name, _tests in {"b102": ["B102"], "b105": ["B105"], "b301": ["B301"], "b403": ["B403"], "b404": ["B404"], "b602": ["B602"]}.items():
    _rule(_name, *_tests)


@query("joi07", "SELECT p_partkey AS file_id, 9 AS lineno, 'B102' AS test_id FROM part WHERE p_size < 10")
def suppression(spark, sf_dir):
    """What the nosec comments suppress."""
    f = files(spark, sf_dir)
    return judged(f)[1].select("file_id", "lineno", "test_id")


@query("flt01", f"SELECT * FROM ({_ISSUES}) WHERE severity IN ('MEDIUM', 'HIGH') AND confidence = 'HIGH'")
def severity_filter(spark, sf_dir):
    return _shown(rules.filtered(issues(spark, sf_dir), "MEDIUM", "HIGH"))


@query("flt02", f"SELECT file_id, test_id, lineno FROM ({_ISSUES})")
def projection(spark, sf_dir):
    return issues(spark, sf_dir).select("file_id", "test_id", "lineno")


@query("agg13", f"WITH i AS ({_ISSUES}), w(rank, weight) AS (VALUES ('LOW', 3), ('MEDIUM', 5), ('HIGH', 10)), s AS (SELECT severity AS rank, count(*) AS issues, sum(weight)::BIGINT AS severity_score FROM i JOIN w ON severity = rank GROUP BY ALL), c AS (SELECT confidence AS rank, sum(weight)::BIGINT AS confidence_score FROM i JOIN w ON confidence = rank GROUP BY ALL) SELECT coalesce(s.rank, c.rank) AS rank, coalesce(issues, 0) AS issues, coalesce(severity_score, 0) AS severity_score, coalesce(confidence_score, 0) AS confidence_score FROM s FULL JOIN c ON s.rank = c.rank")
def issue_metrics(spark, sf_dir):
    return rules.metrics(issues(spark, sf_dir))


@query("agg14", f"SELECT file_id, sum(CASE WHEN severity = 'LOW' THEN 3 ELSE 0 END)::BIGINT AS low, sum(CASE WHEN severity = 'MEDIUM' THEN 5 ELSE 0 END)::BIGINT AS medium, sum(CASE WHEN severity = 'HIGH' THEN 10 ELSE 0 END)::BIGINT AS high FROM ({_ISSUES}) GROUP BY ALL")
def scores(spark, sf_dir):
    part = lambda r, w: F.sum(F.when(F.col("severity") == r, w).otherwise(0))
    return issues(spark, sf_dir).groupBy("file_id").agg(part("LOW", 3).alias("low"), part("MEDIUM", 5).alias("medium"), part("HIGH", 10).alias("high"))


@query("snk04")
def json_sink(spark, sf_dir):
    return rules.json_report(issues(spark, sf_dir))


@query("snk05")
def sarif_sink(spark, sf_dir):
    return rules.sarif_report(issues(spark, sf_dir))


@query("snk06")
def text_sink(spark, sf_dir):
    return rules.text_report(issues(spark, sf_dir))


@query("src05", "SELECT p_partkey AS file_id, 'Module' AS kind, 1 AS n FROM part UNION ALL SELECT p_partkey, 'FunctionDef', 2 FROM part UNION ALL SELECT p_partkey, 'Call', 4 FROM part UNION ALL SELECT p_partkey, 'If', 1 FROM part")
def parsed(spark, sf_dir):
    return nodes(spark, sf_dir, ("Module", "FunctionDef", "Call", "If"), ("file_id", "kind")).groupBy("file_id", "kind").agg(F.count("*").alias("n"))


@query("src07", "SELECT p_partkey AS file_id, unnest(CASE WHEN p_size % 2 = 0 THEN ['os', 'pickle'] ELSE ['os', 'subprocess'] END) AS module FROM part")
def found_imports(spark, sf_dir):
    return python.imports(written(nodes(spark, sf_dir, ("alias", "Import", "ImportFrom"), ("file_id", "node_id", "parent_id", "kind", "name"))))


@query("src08", "SELECT 'pkg.' || lower(replace(p_brand, '#', '_')) || '.m_' || p_partkey AS module, 'pkg/' || lower(replace(p_brand, '#', '_')) || '/m_' || p_partkey || '.py' AS path FROM part")
def module_names(spark, sf_dir):
    return python.modules(files(spark, sf_dir))


@query("scl31", "SELECT p_partkey AS file_id, 'pkg.' || lower(replace(p_brand, '#', '_')) || '.m_' || p_partkey AS module FROM part")
def qualname_from_path(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", module_name("path").alias("module"))


@query("src16", "SELECT p_partkey AS file_id, 9 AS line FROM part WHERE p_size < 10")
def comments(spark, sf_dir):
    return python.suppressions(files(spark, sf_dir)).select("file_id", "line")


@query("irx02", "SELECT p_partkey AS file_id, unnest(['main.g_' || p_partkey, 'main.f_' || p_partkey]) AS qualname FROM part")
def extracted(spark, sf_dir):
    return python.functions(nodes(spark, sf_dir, ("FunctionDef", "AsyncFunctionDef", "ClassDef"), ("file_id", "node_id", "kind", "qualname"))).select("file_id", "qualname")


@query("irx06", "SELECT p_partkey AS file_id, 'main.g_' || p_partkey AS scope, 'b' AS name, 'load' AS mode, 3 AS times FROM part")
def def_use(spark, sf_dir):
    return python.definitions_and_uses(nodes(spark, sf_dir, ("Name",), ("file_id", "kind", "scope", "name", "value"))).filter("name = 'b'")


@query("cgr01", "SELECT p_partkey AS file_id, unnest(['main', 'main.f_' || p_partkey]) AS caller, unnest(['main.f_' || p_partkey, 'main.g_' || p_partkey]) AS callee FROM part")
def simple_call_graph(spark, sf_dir):
    return callgraph.call_graph(written(nodes(spark, sf_dir, callgraph.KINDS, callgraph.COLUMNS)))


def _graph(spark, sf_dir):
    n = written(nodes(spark, sf_dir, callgraph.KINDS, callgraph.COLUMNS))
    members = n.filter("kind = 'FunctionDef'").select("file_id", F.col("qualname").alias("caller")).union(n.filter("kind = 'Module'").select("file_id", F.lit("main")))
    return callgraph.adjacency(callgraph.call_graph(n), members)


@query("snk01", "SELECT p_partkey AS file_id, unnest(['main -> main.f_' || p_partkey, 'main.f_' || p_partkey || ' -> main.g_' || p_partkey, 'main.g_' || p_partkey || ' -> (no calls)']) AS line FROM part")
def graph_text(spark, sf_dir):
    return callgraph.as_text(_graph(spark, sf_dir))


@query("snk02", """SELECT p_partkey AS file_id, unnest(['"main";', '"main.f_' || p_partkey || '";', '"main.g_' || p_partkey || '";', '"main" -> "main.f_' || p_partkey || '";', '"main.f_' || p_partkey || '" -> "main.g_' || p_partkey || '";']) AS line FROM part""")
def graph_dot(spark, sf_dir):
    return callgraph.as_dot(_graph(spark, sf_dir))


@query("snk03", """SELECT p_partkey AS file_id, '{"functions":["main","main.f_' || p_partkey || '","main.g_' || p_partkey || '"],"invocations":{"main":["main.f_' || p_partkey || '"],"main.f_' || p_partkey || '":["main.g_' || p_partkey || '"],"main.g_' || p_partkey || '":[]}}' AS json FROM part""")
def graph_json(spark, sf_dir):
    return callgraph.as_json(_graph(spark, sf_dir))


@query("joi06", "SELECT p_partkey AS file_id, CASE WHEN p_size % 2 = 0 THEN 'pickle.loads' ELSE 'subprocess.Popen' END AS qualname FROM part")
def alias_resolution(spark, sf_dir):
    return nodes(spark, sf_dir, ("Call",), ("file_id", "kind", "qualname")).filter(F.col("kind").eqNullSafe("Call") & F.col("qualname").isin("pickle.loads", "subprocess.Popen")).select("file_id", "qualname")


@query("scl25", "SELECT p_partkey AS file_id, 'bool:True' AS shell FROM part WHERE p_size % 2 <> 0")
def call_literals(spark, sf_dir):
    return nodes(spark, sf_dir, ("Call",), ("file_id", "kw")).select("file_id", F.element_at("kw", F.lit("shell")).alias("shell")).filter("shell is not null")


@query("scl26", "SELECT DISTINCT cwe, 'https://cwe.mitre.org/data/definitions/' || cwe || '.html' AS link FROM (VALUES (78), (259), (502)) t(cwe)")
def links(spark, sf_dir):
    return issues(spark, sf_dir).select("cwe").distinct().select("cwe", cwe_link("cwe").alias("link"))


@query("scl27", """SELECT doc_id, unnest(regexp_extract_all(text, '(\\w+)\\s*=\\s*"([^"]*)"', 1)) AS name, unnest(regexp_extract_all(text, '(\\w+)\\s*=\\s*"([^"]*)"', 2)) AS literal FROM documents WHERE regexp_matches(text, '(?i)token\\s*=\\s*"')""")
def credential_literals(spark, sf_dir):
    """Credentials in the documents' whole texts."""
    pattern = r'(\w+)\s*=\s*"([^"]*)"'
    d = table(spark, sf_dir, "documents")
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("l"))
    return d.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", F.col("p.n").alias("name"), F.col("p.l").alias("literal")).filter(credential_name("name"))


@query("scl28", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages")
def markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", escape_markup("html").alias("html"))


@query("scl29", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("scl30", "SELECT p_partkey AS file_id, unnest([4, 8]) AS lineno, unnest([7, 10]) AS last FROM part")
def line_ranges(spark, sf_dir):
    spans = nodes(spark, sf_dir, ("FunctionDef",), ("file_id", "lineno", "end_lineno")).select("file_id", "lineno", F.sequence("lineno", "end_lineno").alias("lines"))
    return spans.select("file_id", "lineno", F.element_at("lines", -1).alias("last"))


@query("snk07", "WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), i AS (SELECT doc, line FROM l WHERE contains(text, 'License')) SELECT i.doc, i.line, string_agg(l.line || ' ' || l.text, chr(10) ORDER BY l.line) AS code FROM i JOIN l ON i.doc = l.doc AND l.line BETWEEN i.line - 1 AND i.line + 1 GROUP BY ALL")
def excerpts(spark, sf_dir):
    """Lines around each license line."""
    from ..operators.order import excerpt

    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("doc", (F.col("p") + 1).cast("long").alias("line"), "text")
    return excerpt(lines, lines.filter(F.contains("text", F.lit("License"))).select("doc", "line"))
