"""Further queries: products, priorities, contexts, lowering, summaries and scopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conditions, flow, graph, lattice, pointsto
from ..operators.fixpoint import fixpoint
from ..shared import written
from .analyses import _KILL, _TREES, _program, _reads, _trees
from .base import EDGE, FLOW, TREE, edges, nodes as program_nodes, query, roots, table, tree
from .base import flow as flow_edges
from .programs import files, nodes

_FACTS = "SELECT DISTINCT l_orderkey AS site, l_returnflag AS a, l_linestatus AS b FROM lineitem"


def _product(spark, sf_dir):
    """Each call site's argument types, one set for each argument, then their product: the sets hold two or three kinds."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("site")).agg(F.collect_set("l_returnflag").alias("x"), F.collect_set("l_linestatus").alias("y"))
    return l.select("site", F.explode("x").alias("a"), "y").select("site", "a", F.explode("y").alias("b"))


_PRODUCT = f"WITH f AS ({_FACTS}) SELECT DISTINCT p.site, p.a, q.b FROM f p JOIN f q ON p.site = q.site"


@query("joi03", _PRODUCT)
def cartesian(spark, sf_dir):
    return _product(spark, sf_dir)


@query("joi16", f"SELECT site, count(*) AS signatures FROM ({_PRODUCT}) GROUP BY site")
def signatures(spark, sf_dir):
    return _product(spark, sf_dir).groupBy("site").agg(F.count("*").alias("signatures"))


@query("pts08", f"SELECT DISTINCT a || ',' || b AS signature, md5(a || ',' || b) AS ctx FROM ({_PRODUCT})")
def contexts(spark, sf_dir):
    """Contexts made once for each signature, with ids from their content."""
    s = _product(spark, sf_dir).select(F.concat_ws(",", "a", "b").alias("signature")).distinct()
    return s.withColumn("ctx", F.md5("signature"))


_COPYCTE = f"WITH RECURSIVE {FLOW}, copy AS (SELECT DISTINCT 'n' || src AS src, 'n' || dst AS dst FROM flow WHERE kind = '1-URGENT'), pts(slot, obj) AS (SELECT 'n' || id, 'o' || id FROM node UNION SELECT c.dst, p.obj FROM pts p JOIN copy c ON p.slot = c.src)"


@query("joi04", f"{_COPYCTE} SELECT DISTINCT '@' || p.obj || '.f' AS src, 'n' || f.dst AS dst FROM flow f JOIN pts p ON p.slot = 'n' || f.src WHERE f.kind = '2-HIGH'")
def load_join(spark, sf_dir):
    """The copies that loads make from the fields of what their base points to."""
    own, copy, load, _ = _program(spark, sf_dir)
    return pointsto.flow(own, copy).join(load, F.col("slot") == F.col("base")).select(pointsto.field_slot(F.col("obj"), F.col("field")).alias("src"), "dst").distinct()


@query("joi05", f"{_COPYCTE} SELECT DISTINCT 'n' || f.dst AS src, '@' || p.obj || '.f' AS dst FROM flow f JOIN pts p ON p.slot = 'n' || f.src WHERE f.kind = '3-MEDIUM'")
def store_join(spark, sf_dir):
    own, copy, _, store = _program(spark, sf_dir)
    return pointsto.flow(own, copy).join(store, F.col("slot") == F.col("base")).select("src", pointsto.field_slot(F.col("obj"), F.col("field")).alias("dst")).distinct()


@query("ipa06", f"{_COPYCTE} SELECT '@' || p.obj || '.f' AS field, count(DISTINCT f.dst) AS writers FROM flow f JOIN pts p ON p.slot = 'n' || f.src WHERE f.kind = '3-MEDIUM' GROUP BY ALL")
def memory(spark, sf_dir):
    return store_join(spark, sf_dir).groupBy(F.col("dst").alias("field")).agg(F.count_distinct("src").alias("writers"))


@query("ipa10", f"{_COPYCTE} SELECT obj, count(*) AS slots FROM pts GROUP BY obj")
def exact_split(spark, sf_dir):
    own, copy, _, _ = _program(spark, sf_dir)
    return pointsto.flow(own, copy).groupBy("obj").agg(F.count("*").alias("slots"))


@query("ipa15", f"{_COPYCTE} SELECT DISTINCT slot FROM pts WHERE obj IN (SELECT 'o' || id FROM node WHERE top)")
def criticals(spark, sf_dir):
    """Slots that critical names (orders' first lines) reach."""
    own, copy, _, _ = _program(spark, sf_dir)
    return pointsto.flow(own.join(roots(spark, sf_dir).select(F.concat(F.lit("o"), F.col("node").cast("string")).alias("obj")), "obj", "left_semi"), copy).select("slot").distinct()


@query("ipa13", "SELECT c_custkey AS obj, CASE WHEN c_nationkey = 0 THEN 'GLBL' WHEN c_acctbal < 0 THEN 'DN' WHEN c_acctbal > 9000 THEN 'UP' ELSE 'HZ' END AS qualifier FROM customer")
def qualifiers(spark, sf_dir):
    q = F.when(F.col("c_nationkey") == 0, "GLBL").when(F.col("c_acctbal") < 0, "DN").when(F.col("c_acctbal") > 9000, "UP").otherwise("HZ")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obj"), q.alias("qualifier"))


@query("ipa07", "SELECT l_partkey AS slot, unnest(list_distinct([l_returnflag = 'R' OR l_returnflag = 'A', l_linestatus = 'F'])) AS result FROM lineitem ")
def check_matrix(spark, sf_dir):
    one = F.array_distinct(F.array(F.col("l_returnflag").isin("R", "A"), F.col("l_linestatus") == "F"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("slot"), F.explode(one).alias("result"))


@query("joi19", "SELECT 'C' || c_custkey AS start, CASE WHEN n_name LIKE 'A%' OR n_name LIKE 'I%' OR n_name LIKE '%0' THEN 'N' || n_nationkey ELSE 'R' || n_regionkey END AS found FROM customer JOIN nation ON c_nationkey = n_nationkey")
def method_lookup(spark, sf_dir):
    """The nearest base that declares a method: some nations do, all regions do; the start itself does not count."""
    n = F.col("n_name")
    declares = table(spark, sf_dir, "nation").filter(n.like("A%") | n.like("I%") | n.like("%0")).select(F.concat(F.lit("N"), "n_nationkey").alias("ancestor")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey")))
    up = graph.ancestors(tree(spark, sf_dir)).filter("distance > 0 and node like 'C%'")
    return up.join(declares, "ancestor").groupBy(F.col("node").alias("start")).agg(F.min_by("ancestor", "distance").alias("found"))


@query("flt05", "SELECT o_orderkey AS code FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '5%'")
def standard_code(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") != "P") & ~F.col("o_orderpriority").like("5%")).select(F.col("o_orderkey").alias("code"))


@query("flt08", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
def typed_view(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey", "l_linenumber")


@query("flt09", "SELECT p_partkey AS file_id, 3 + CASE WHEN p_size < 10 THEN 1 ELSE 1 END AS calls, 2 AS functions FROM part")
def projections(spark, sf_dir):
    """Operations and definitions of each file, split from its tree."""
    n = nodes(spark, sf_dir, ("Module", "Call", "FunctionDef"), ("file_id", "kind")).groupBy("file_id").agg(F.count_if(F.col("kind") == "Call").cast("int").alias("calls"), F.count_if(F.col("kind") == "FunctionDef").cast("int").alias("functions"))
    return n


@query("srt02", f"WITH RECURSIVE {TREE}, lv AS (SELECT node, 0 AS level FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, lv.level + 1 FROM tree t JOIN lv ON t.parent = lv.node) SELECT node, 2 - level AS priority FROM lv")
def priorities(spark, sf_dir):
    """Constraints in post-order: the deepest first."""
    up = graph.ancestors(tree(spark, sf_dir)).groupBy("node").agg((2 - F.max("distance")).alias("priority"))
    return up


@query("srt03", f"WITH {EDGE}, b AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge) SELECT src AS node, count(*) AS degree, row_number() OVER (PARTITION BY src // 10 ORDER BY count(*) DESC, src) AS place FROM b GROUP BY src")
def by_degree(spark, sf_dir):
    """Each program's nodes, those with most neighbours first."""
    e = edges(spark, sf_dir)
    both = e.union(e.select("dst", "src")).distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(F.expr("node div 10")).orderBy(F.desc("degree"), "node")))


@query("srt07", "SELECT o_orderkey, k, (k + coalesce(lead(k) OVER (PARTITION BY o_custkey ORDER BY k), k + 1)) / 2.0 AS between FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)")
def order_tags(spark, sf_dir):
    """Tags that keep an order, and a tag between each row and the next for what may be inserted."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w))
    return t.withColumn("between", (F.col("k") + F.coalesce(F.lead("k").over(w), F.col("k") + 1)) / 2.0).select("o_orderkey", "k", "between")


@query("set06", f"WITH {_TREES} SELECT tree, flag, list_sort(list_distinct(CASE WHEN value THEN ['both', 'open'] ELSE ['both'] END)) AS value FROM trees")
def conditional_sets(spark, sf_dir):
    """Unions of sets lifted over condition trees."""
    t = _trees(spark, sf_dir)
    a = t.withColumn("value", F.when(F.col("value"), F.array(F.lit("open"))).otherwise(F.array().cast("array<string>")))
    b = t.withColumn("value", F.array(F.lit("both")))
    return conditions.lift(a, b, lambda x, y: F.array_sort(F.array_union(x, y))).select("tree", F.element_at("path", F.lit("flag")).alias("flag"), "value")


def _walk(spark, sf_dir, limit):
    e = written(edges(spark, sf_dir))
    return fixpoint(roots(spark, sf_dir), lambda d, _: d.join(e, d["node"] == e["src"]).select(F.col("dst").alias("node")), limit=limit)


@query("str01", f"WITH RECURSIVE {EDGE}, w(node) AS (SELECT id FROM node WHERE top UNION SELECT e.dst FROM w JOIN edge e ON w.node = e.src) SELECT count(*) AS nodes, true AS converged FROM w")
def worklist(spark, sf_dir):
    rows, _, converged = _walk(spark, sf_dir, None)
    return rows.agg(F.count("*").alias("nodes"), F.lit(converged).alias("converged"))


@query("str03", f"WITH {EDGE}, r AS (SELECT id AS node FROM node WHERE top) SELECT count(*) AS nodes, false AS converged FROM (SELECT node FROM r UNION SELECT e.dst FROM r JOIN edge e ON r.node = e.src)")
def limited(spark, sf_dir):
    """One round only: the result says that it has not converged."""
    rows, _, converged = _walk(spark, sf_dir, 1)
    return rows.agg(F.count("*").alias("nodes"), F.lit(converged).alias("converged"))


@query("str02", f"WITH RECURSIVE {EDGE}, lv(node, level) AS (SELECT id, 0 FROM node WHERE top UNION SELECT e.dst, l.level + 1 FROM lv l JOIN edge e ON l.node = e.src WHERE l.level < 25), m AS (SELECT node, min(level) AS level FROM lv GROUP BY node) SELECT level AS round, count(*) AS fresh FROM m GROUP BY level")
def deltas(spark, sf_dir):
    """How many nodes each round of propagation adds."""
    return graph.levels(edges(spark, sf_dir), roots(spark, sf_dir)).groupBy(F.col("level").alias("round")).agg(F.count("*").alias("fresh"))


@query("irx01", "SELECT p_partkey AS file_id, 'Return' AS kind, 2 AS n FROM part UNION ALL SELECT p_partkey, 'arg', 2 FROM part UNION ALL SELECT p_partkey, 'Assign', 1 FROM part")
def converted(spark, sf_dir):
    return nodes(spark, sf_dir, ("Return", "arg", "Assign"), ("file_id", "kind")).groupBy("file_id", "kind").agg(F.count("*").cast("int").alias("n"))


@query("irx09", "SELECT p_partkey AS file_id, 'main.f_' || p_partkey AS definition, 'function' AS kind, 8 AS line FROM part")
def definitions(spark, sf_dir):
    return nodes(spark, sf_dir, ("FunctionDef",), ("file_id", "name", "qualname", "lineno")).filter("name like 'f\\_%'").select("file_id", F.col("qualname").alias("definition"), F.lit("function").alias("kind"), F.col("lineno").alias("line"))


@query("irx08", "SELECT p_partkey AS file_id, unnest(['main', 'main.f_' || p_partkey, 'main.g_' || p_partkey]) AS scope FROM part")
def scopes(spark, sf_dir):
    return nodes(spark, sf_dir, None, ("file_id", "scope")).distinct()


@query("irx10", "SELECT p_partkey AS file_id, unnest([0, 1, 2, 3, 4, 5]) AS idx FROM part")
def statements(spark, sf_dir):
    """Top-level statements in order."""
    n = nodes(spark, sf_dir, None, ("file_id", "parent_id", "field", "idx"))
    return n.filter("parent_id = 0 and field = 'body'").select("file_id", "idx")


@query("irx07", "SELECT p_partkey AS file_id, 'limit' AS name FROM part WHERE p_size >= 10")
def collapsible(spark, sf_dir):
    """Locals with one definition and one use, which can stand where they are used."""
    n = nodes(spark, sf_dir, ("Name",), ("file_id", "scope", "name", "value")).groupBy("file_id", "scope", "name").agg(F.count_if(F.col("value") == "Store").alias("d"), F.count_if(F.col("value") == "Load").alias("u"))
    return n.filter("d = 1 and u = 1").select("file_id", "name")


@query("irx04", "SELECT p_partkey AS file_id, CASE WHEN p_size % 2 = 0 THEN 'interpreter_getattribute' ELSE 'interpreter_call' END AS target FROM part")
def lowered(spark, sf_dir):
    """Calls lowered to the interpreter's functions: through an attribute, or of a name with keywords."""
    n = nodes(spark, sf_dir, ("Call",), ("file_id", "qualname")).filter("qualname in ('pickle.loads', 'subprocess.Popen')")
    return n.select("file_id", F.when(F.col("qualname") == "pickle.loads", "interpreter_getattribute").otherwise("interpreter_call").alias("target"))


@query("pts02", "SELECT p_partkey AS file_id, CASE WHEN p_size < 10 THEN 'token' ELSE 'limit' END AS slot, CASE WHEN p_size < 10 THEN p_brand ELSE '1' END AS obj FROM part")
def extracted_constraints(spark, sf_dir):
    """Allocations of constants to module variables."""
    n = written(nodes(spark, sf_dir, ("Name", "Constant"), ("file_id", "parent_id", "field", "kind", "name", "value", "scope")))
    target = n.filter("kind = 'Name' and value = 'Store' and scope = 'main'").select("file_id", "parent_id", F.col("name").alias("slot"))
    value = n.filter("kind = 'Constant' and field = 'value'").select("file_id", "parent_id", F.col("value").alias("obj"))
    return target.join(value, ["file_id", "parent_id"]).select("file_id", "slot", "obj")


@query("pts09", "SELECT p_partkey AS obj, CASE WHEN p_type LIKE 'PROMO%' THEN 'method:' || p_brand WHEN p_size < 10 THEN 'context:' || p_size ELSE 'path:' || p_partkey END AS name FROM part")
def naming(spark, sf_dir):
    n = F.when(F.col("p_type").like("PROMO%"), F.concat(F.lit("method:"), "p_brand")).when(F.col("p_size") < 10, F.concat(F.lit("context:"), "p_size")).otherwise(F.concat(F.lit("path:"), "p_partkey"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj"), n.alias("name"))


@query("pts16", "SELECT md5(p_brand || '/' || p_type) AS id, count(*) AS uses FROM part GROUP BY ALL")
def canonical(spark, sf_dir):
    """Equal names have one id, made from their content."""
    return table(spark, sf_dir, "part").groupBy(F.md5(F.concat_ws("/", "p_brand", "p_type")).alias("id")).agg(F.count("*").alias("uses"))


@query("pts12", "SELECT 'C' || c_custkey AS slot, 'N' || c_nationkey AS obj FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier")
def heap_image(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("slot"), F.concat(F.lit("N"), "c_nationkey").alias("obj"))
    return c.union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "s_nationkey")))


@query("lif04", f"{_KILL} SELECT DISTINCT c.src AS code, c.kind AS op, g.obj FROM call c JOIN facts g ON g.code = c.dst WHERE c.kind = '5-LOW' AND g.obj = 0")
def killed(spark, sf_dir):
    """What is live in a callee and dies on the edge to its caller."""
    facts, calls = _reads(spark, sf_dir)
    below = facts.select(F.col("code").alias("dst"), "obj")
    return calls.filter("op = '5-LOW'").join(below, "dst").filter("obj = 0").select(F.col("src").alias("code"), "op", "obj").distinct()


@query("lif07", f"{_KILL} SELECT code, list_sort(list(obj)) AS live FROM facts GROUP BY code")
def result_database(spark, sf_dir):
    return _reads(spark, sf_dir)[0].groupBy("code").agg(F.array_sort(F.collect_set("obj")).alias("live"))


@query("dfi04", f"WITH RECURSIVE {EDGE}, live(node) AS (SELECT id FROM node WHERE bottom UNION SELECT e.src FROM live l JOIN edge e ON l.node = e.dst) SELECT node FROM live")
def needed(spark, sf_dir):
    """Operations that the exit needs: reachable over reversed edges."""
    return graph.reach(graph.reverse(edges(spark, sf_dir)), program_nodes(spark, sf_dir).filter("bottom").select(F.col("id").alias("node")))


@query("dfi07", "SELECT l_orderkey AS op, list_sort(list_distinct(list(l_partkey) FILTER (l_returnflag <> 'R'))) AS read, list_sort(list_distinct(list(l_partkey) FILTER (l_returnflag = 'R'))) AS modify FROM lineitem GROUP BY ALL")
def annotations(spark, sf_dir):
    side = lambda c: lattice.or_null(F.array_sort(F.collect_set(F.when(c, F.col("l_partkey")))))
    r = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("op")).agg(side(~r).alias("read"), side(r).alias("modify"))


@query("cnd08", f"WITH RECURSIVE {EDGE}, walk(src, dst) AS (SELECT src, dst FROM edge UNION SELECT w.src, e.dst FROM walk w JOIN edge e ON w.dst = e.src) SELECT src // 10 AS program, bool_or(src = dst) AS recursive FROM walk GROUP BY src // 10")
def recursion_guard(spark, sf_dir):
    """Which programs are recursive: their networks are refused."""
    return graph.closure(edges(spark, sf_dir), cycles=True).groupBy(F.expr("src div 10").alias("program")).agg(F.bool_or(F.col("src") == F.col("dst")).alias("recursive"))


@query("opt10", "SELECT p_partkey AS file_id, unnest(['main.f_' || p_partkey, 'main.g_' || p_partkey]) AS func FROM part")
def inlinable(spark, sf_dir):
    """Functions without a return inside a loop."""
    return flow.inlinable(files(spark, sf_dir))


@query("opt13", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'identity' WHEN l_tax = 0 THEN 'drop' ELSE 'keep' END AS rule FROM lineitem")
def rewriting(spark, sf_dir):
    r = F.when(F.col("l_linenumber") == 1, "identity").when(F.col("l_tax") == 0, "drop").otherwise("keep")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("rule"))


@query("snk17", "SELECT p_partkey AS file_id, 'main.f_' || p_partkey AS func, 'exec(a); return g_' || p_partkey || '(a)' AS code FROM part")
def printed(spark, sf_dir):
    """Code of blocks as text again."""
    return flow.blocks(files(spark, sf_dir)).filter("block = 2 and func like 'main.f%'").select("file_id", "func", "code")


@query("snk13", "SELECT n_nationkey AS page, '<h1>' || replace(n_name, '&', '&amp;') || '</h1><p>' || count(c_custkey) || '</p>' AS html FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def report_pages(spark, sf_dir):
    from ..functions.names import escape_markup

    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select(F.col("n_nationkey").alias("page"), F.concat(F.lit("<h1>"), escape_markup("n_name"), F.lit("</h1><p>"), F.coalesce("n", F.lit(0)).cast("string"), F.lit("</p>")).alias("html"))


@query("snk14", f"WITH {FLOW} SELECT DISTINCT 'n' || src || ' -> n' || dst || ';' AS line FROM flow")
def invocation_picture(spark, sf_dir):
    return flow_edges(spark, sf_dir).select(F.format_string("n%d -> n%d;", "src", "dst").alias("line")).distinct()


@query("src03", "SELECT DISTINCT 'pkg/' || lower(replace(p_brand, '#', '_')) AS folder, count(*) AS files FROM part WHERE p_brand NOT LIKE '%11' GROUP BY p_brand")
def discovered(spark, sf_dir):
    """Files by folder, without an excluded folder."""
    from ..functions.names import dir_name, glob_match

    f = files(spark, sf_dir).withColumn("folder", dir_name("path")).filter(~glob_match("folder", "*11"))
    return f.groupBy("folder").agg(F.count("*").alias("files"))


@query("src10", "SELECT p_partkey AS file_id, 'f_' || p_partkey AS call, 'limit' AS arg FROM part")
def accessors(spark, sf_dir):
    """Dotted call names and arguments."""
    n = nodes(spark, sf_dir, ("Call",), ("file_id", "qualname", "scope", "args")).filter("scope = 'main'")
    return n.select("file_id", F.col("qualname").alias("call"), F.get("args", F.lit(0))["name"].alias("arg"))


@query("src12", "SELECT p_partkey AS file_id, 'main.f_' || p_partkey AS code, 0 AS position, 'a' AS name FROM part UNION ALL SELECT p_partkey, 'main.g_' || p_partkey, 0, 'b' FROM part")
def entry_points(spark, sf_dir):
    args = nodes(spark, sf_dir, ("arg",), ("file_id", "scope", "idx", "name")).select("file_id", F.col("scope").alias("code"), F.col("idx").alias("position"), "name")
    return args

