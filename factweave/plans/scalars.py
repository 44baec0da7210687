"""Queries of scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, values
from .base import query, table

_L = "CAST(l_quantity AS BIGINT)"


@query("scl01", f"SELECT l_orderkey, l_linenumber, {_L} + l_linenumber AS a, {_L} - l_linenumber AS s, {_L} * l_linenumber AS m, CASE WHEN l_linenumber <> 1 THEN {_L} / (l_linenumber - 1) END AS d, CASE WHEN l_linenumber <> 1 THEN {_L} // (l_linenumber - 1) END AS q, CASE WHEN l_linenumber <> 1 THEN {_L} % (l_linenumber - 1) END AS r, {_L} & l_linenumber AS x, {_L} > l_linenumber AS g FROM lineitem")
def binary(spark, sf_dir):
    l, r = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", values.fold("+", l, r).alias("a"), values.fold("-", l, r).alias("s"), values.fold("*", l, r).alias("m"), values.fold("/", l, r - 1).alias("d"),
        values.fold("//", l, r - 1).alias("q"), values.fold("%", l, r - 1).alias("r"), values.fold("&", l, r).alias("x"), values.fold(">", l, r).alias("g"),
    )


@query("scl02", "SELECT p_partkey, +p_size AS pos, -p_size AS neg, ~p_size AS inv FROM part")
def unary(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.positive("p_size").alias("pos"), F.negative("p_size").alias("neg"), F.bitwise_not("p_size").alias("inv"))


@query("scl03", "SELECT event_id, value IS NOT NULL AND value <> 0 AS number, length(coalesce(props, '')) > 0 AS string FROM events")
def truthiness(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.truth(F.col("value"), "float").alias("number"), values.truth(F.col("props"), "str").alias("string"))


@query("scl04", "SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, abs(-p_size) AS a FROM part")
def calls(spark, sf_dir):
    """Pure functions that may be folded, as expressions."""
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("up"), F.length("p_name").alias("n"), F.abs(-F.col("p_size")).alias("a"))


@query("scl05", "SELECT l_orderkey, l_linenumber, unnest(CASE WHEN l_returnflag <> 'N' THEN [false] WHEN l_linestatus = 'O' THEN [l_discount = l_tax] ELSE [false, true] END) AS result FROM lineitem")
def identities(spark, sf_dir):
    found = values.identity(F.col("l_returnflag") == "N", F.col("l_linestatus") == "O", F.col("l_discount") == F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(found).alias("result"))


@query("scl06", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in values.BINARY.items()) + ") t(op, forward, reflected)")
def operator_names(spark, sf_dir):
    return spark.createDataFrame([(k, *v) for k, v in values.BINARY.items()], "op string, forward string, reflected string")


@query("scl07", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity END AS times, CASE WHEN l_tax = 0 THEN l_quantity END AS plus FROM lineitem")
def algebra(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.simplified("*", F.col("l_linenumber"), q).alias("times"), values.simplified("+", F.col("l_tax"), q).alias("plus"))


@query("scl08", "SELECT l_orderkey, l_linenumber, l_tax = 0 AS zero, l_linenumber = 1 AS one, l_quantity < 0 AS negative FROM lineitem")
def term_tests(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") == 0).alias("zero"), (F.col("l_linenumber") == 1).alias("one"), (F.col("l_quantity") < 0).alias("negative"))


@query("scl09", "SELECT p_partkey, p_size + 3 AS a, p_size - 30 AS s, p_size * p_size AS m, p_size % 7 AS r, p_size < 25 AS lt, p_size <= 25 AS le, p_size > 25 AS gt, p_size >= 25 AS ge, p_size = 25 AS eq, p_size <> 25 AS ne FROM part")
def integers(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", (n + 3).alias("a"), (n - 30).alias("s"), (n * n).alias("m"), (n % 7).alias("r"), (n < 25).alias("lt"), (n <= 25).alias("le"), (n > 25).alias("gt"), (n >= 25).alias("ge"), (n == 25).alias("eq"), (n != 25).alias("ne"))


@query("scl10", "SELECT o_orderkey, -o_totalprice AS neg, round(o_totalprice * 1.5, 4) AS m, round(o_totalprice / 3, 4) AS d, o_totalprice > 100000 AS gt, CAST(o_orderkey AS DOUBLE) AS f FROM orders")
def floats(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", (-p).alias("neg"), F.round(p * 1.5, 4).alias("m"), F.round(p / 3, 4).alias("d"), (p > 100000).alias("gt"), F.col("o_orderkey").cast("double").alias("f"))


@query("scl11", "SELECT p_partkey, p_name || p_brand AS a, repeat(p_brand, 2) AS m, printf('%s:%d', p_brand, p_size) AS f, p_name < p_type AS lt, chr(65 + p_size % 26) AS c, ascii(p_name) AS o, substr(p_name, 2, 1) AS i FROM part")
def strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_brand").alias("a"), F.repeat("p_brand", 2).alias("m"), F.format_string("%s:%d", "p_brand", "p_size").alias("f"), (F.col("p_name") < F.col("p_type")).alias("lt"), F.chr(65 + F.col("p_size") % 26).alias("c"), F.ascii("p_name").alias("o"), F.substring("p_name", 2, 1).alias("i"))


@query("scl12", "SELECT p_partkey, round(exp(p_size / 10.0), 6) AS e, round(ln(p_size + 1.0), 6) AS l FROM part")
def math(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.exp(F.col("p_size") / 10.0), 6).alias("e"), F.round(F.ln(F.col("p_size") + 1.0), 6).alias("l"))


@query("scl13", "SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, NOT (p_size = 1) AS n, string_split(p_name, ' ')[1] AS item, array_to_string(list_slice(string_split(p_name, ' '), 1, 2), ' ') AS slice FROM part")
def operators(spark, sf_dir):
    n, parts = F.col("p_size"), F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", n.bitwiseAND(6).alias("a"), n.bitwiseOR(6).alias("o"), (~(n == 1)).alias("n"), parts[0].alias("item"), F.array_join(F.slice(parts, 1, 2), " ").alias("slice"))


@query("scl14", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"))


@query("scl15", "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has, length(regexp_replace(text, '[0-9]', '', 'g')) AS stripped, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS found, len(string_split(text, chr(10))) AS pieces FROM documents")
def regexes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike("[0-9]{3}").alias("has"), F.length(F.regexp_replace(t, "[0-9]", "")).alias("stripped"), F.size(F.regexp_extract_all(t, F.lit("[A-Z][a-z]+"), F.lit(0))).alias("found"), F.size(F.split(t, "\n", -1)).alias("pieces"))


@query("scl16", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(epoch(o_orderdate) AS BIGINT) AS stamp, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y FROM orders")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM").alias("month"), F.unix_timestamp(d).alias("stamp"), F.to_date(d).alias("day"), F.year(d).alias("y"))


@query("scl17", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("scl18", "SELECT n_nationkey, i, n_name || '-' || i AS pair, [n_nationkey, i] AS chained FROM nation, (SELECT unnest([1, 2, 3]) AS i)")
def iteration(spark, sf_dir):
    """Products, repeats and chains: each row with a fixed sequence."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    return t.select("n_nationkey", "i", F.concat_ws("-", "n_name", F.col("i").cast("string")).alias("pair"), F.concat(F.array("n_nationkey"), F.array("i")).alias("chained"))


@query("scl19", "SELECT p_partkey, CAST(list_sum([length(x) FOR x IN string_split(p_name, ' ')]) AS BIGINT) AS total FROM part")
def reduce(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.aggregate(F.split("p_name", " "), F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("total"))


@query("scl20", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS item, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part")
def containers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "item")).select("p_partkey", "item", F.col("i").cast("long").alias("i"))


@query("scl21", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir FROM pages")
def paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.base_name("url").alias("base"), names.dir_name("url").alias("dir"))


@query("scl24", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo FROM lineitem")
def extremes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("hi"), F.least("l_discount", "l_tax").alias("lo"))


@query("scl32", "SELECT p_partkey, CAST(CASE WHEN p_size > 1 THEN ceil(log2(p_size)) ELSE 0 END AS INTEGER) AS bits FROM part")
def bits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.number_of_bits(F.col("p_size")).alias("bits"))


@query("scl33", "SELECT user_id, CAST(arg_max(CAST(json_extract(props, '$.k') AS INTEGER), (ts, event_id)) AS INTEGER) AS k FROM events WHERE props IS NOT NULL GROUP BY user_id")
def key_values(spark, sf_dir):
    """The last value put under each key."""
    e = table(spark, sf_dir, "events").filter("props is not null")
    return e.groupBy("user_id").agg(F.max_by(F.get_json_object("props", "$.k").cast("int"), F.struct("ts", "event_id")).alias("k"))


@query("flt10", "SELECT l_orderkey AS op, coalesce(list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber IN (1, 2)))), []) AS merged FROM lineitem GROUP BY ALL")
def remap(spark, sf_dir):
    """Contexts 1 and 2 of each operation merged into one."""
    kept = F.when(F.col("l_linenumber").isin(1, 2), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("op")).agg(F.array_sort(F.collect_set(kept)).alias("merged"))


@query("flt12", "SELECT page_id, url LIKE '%example.com%' AS part, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) IN ('example.com', 'www.example.com') AS exact FROM pages")
def module_predicates(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.contains("url", F.lit("example.com")).alias("part"), host.isin("example.com", "www.example.com").alias("exact"))


@query("joi13", "WITH f AS (SELECT n_nationkey AS callee, n_regionkey + 1 AS formals FROM nation), c AS (SELECT c_custkey AS site, c_nationkey AS callee, 1 + c_custkey % 4 AS actuals FROM customer) SELECT site, least(actuals, formals) AS bound, greatest(actuals - formals, 0) AS extra, greatest(formals - actuals, 0) AS missing, CASE WHEN actuals > formals THEN false WHEN actuals < formals THEN NULL ELSE true END AS succeeds FROM c JOIN f ON c.callee = f.callee")
def binding(spark, sf_dir):
    """Positional arguments of call sites bound to formals; maybe (null) where defaults would have to fill in."""
    f = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("callee"), (F.col("n_regionkey") + 1).alias("formals"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("callee"), (1 + F.col("c_custkey") % 4).alias("actuals"))
    a, n = F.col("actuals"), F.col("formals")
    return c.join(f, "callee").select("site", F.least(a, n.cast("long")).alias("bound"), F.greatest(a - n, F.lit(0)).alias("extra"), F.greatest(n - a, F.lit(0)).alias("missing"), F.when(a > n, False).when(a < n, F.lit(None)).otherwise(True).alias("succeeds"))


@query("joi14", "WITH f AS (SELECT n_nationkey AS callee, n_regionkey + 1 AS formals FROM nation), c AS (SELECT c_custkey AS site, c_nationkey AS callee, 1 + c_custkey % 4 AS actuals FROM customer) SELECT site, CASE WHEN actuals > formals THEN 'too many' WHEN actuals < formals THEN 'too few' ELSE 'ok' END AS reason FROM c JOIN f ON c.callee = f.callee")
def transfer(spark, sf_dir):
    b = binding(spark, sf_dir)
    return b.select("site", F.when(F.col("extra") > 0, "too many").when(F.col("missing") > 0, "too few").otherwise("ok").alias("reason"))


@query("joi12", "SELECT c_custkey AS obj, n_name AS field FROM customer JOIN nation ON c_nationkey = n_nationkey")
def field_seed(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obj"), F.col("c_nationkey").alias("n_nationkey"))
    return c.join(table(spark, sf_dir, "nation"), "n_nationkey").select("obj", F.col("n_name").alias("field"))


@query("joi15", "SELECT o_orderkey AS call, l_linenumber AS position, l_partkey AS actual, 'down' AS way FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, 0, o_custkey, 'up' FROM orders")
def call_binder(spark, sf_dir):
    """Copies down to the formals (lines) and up from the result (customer) of each call (order)."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    down = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("call"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("actual"), F.lit("down").alias("way"))
    return down.union(o.select("o_orderkey", F.lit(0), "o_custkey", F.lit("up")))


@query("joi18", "SELECT n_name AS name, coalesce((SELECT min(r_name) FROM region WHERE r_regionkey = n_regionkey AND r_name <> 'ASIA'), n_name) AS definition FROM nation")
def local_definition(spark, sf_dir):
    r = table(spark, sf_dir, "region").filter("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(r, "n_regionkey", "left").select(F.col("n_name").alias("name"), F.coalesce("r_name", "n_name").alias("definition"))
