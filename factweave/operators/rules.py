"""Security rules as queries over syntax facts, with suppression, filters, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import credential_name, cwe_link
from .order import rank_at_least

#: Weights of ranks in scores (fixed values).
WEIGHTS = {"UNDEFINED": 1, "LOW": 3, "MEDIUM": 5, "HIGH": 10}
#: Calls and imports that are reported by name: test id, node kind, severity, CWE, names (fixed values, first match counts).
BLACKLIST = [
    ("B301", "Call", "MEDIUM", 502, "pickle.loads pickle.load pickle.Unpickler dill.loads dill.load dill.Unpickler shelve.open shelve.DbfilenameShelf jsonpickle.decode jsonpickle.unpickler.decode jsonpickle.unpickler.Unpickler pandas.read_pickle"),
    ("B302", "Call", "MEDIUM", 502, "marshal.load marshal.loads"),
    ("B303", "Call", "MEDIUM", 327, "Crypto.Hash.MD2.new Crypto.Hash.MD4.new Crypto.Hash.MD5.new Crypto.Hash.SHA.new Cryptodome.Hash.MD2.new Cryptodome.Hash.MD4.new Cryptodome.Hash.MD5.new Cryptodome.Hash.SHA.new cryptography.hazmat.primitives.hashes.MD5 cryptography.hazmat.primitives.hashes.SHA1"),
    ("B304", "Call", "HIGH", 327, "Crypto.Cipher.ARC2.new Crypto.Cipher.ARC4.new Crypto.Cipher.Blowfish.new Crypto.Cipher.DES.new Crypto.Cipher.XOR.new Cryptodome.Cipher.ARC2.new Cryptodome.Cipher.ARC4.new Cryptodome.Cipher.Blowfish.new Cryptodome.Cipher.DES.new Cryptodome.Cipher.XOR.new cryptography.hazmat.primitives.ciphers.algorithms.ARC4 cryptography.hazmat.primitives.ciphers.algorithms.Blowfish cryptography.hazmat.primitives.ciphers.algorithms.CAST5 cryptography.hazmat.primitives.ciphers.algorithms.IDEA cryptography.hazmat.primitives.ciphers.algorithms.SEED cryptography.hazmat.primitives.ciphers.algorithms.TripleDES"),
    ("B305", "Call", "MEDIUM", 327, "cryptography.hazmat.primitives.ciphers.modes.ECB"),
    ("B306", "Call", "MEDIUM", 377, "tempfile.mktemp"),
    ("B307", "Call", "MEDIUM", 78, "eval"),
    ("B308", "Call", "MEDIUM", 79, "django.utils.safestring.mark_safe"),
    ("B310", "Call", "MEDIUM", 22, "urllib.request.urlopen urllib.request.urlretrieve urllib.request.URLopener urllib.request.FancyURLopener six.moves.urllib.request.urlopen six.moves.urllib.request.urlretrieve six.moves.urllib.request.URLopener six.moves.urllib.request.FancyURLopener"),
    ("B311", "Call", "LOW", 330, "random.Random random.random random.randrange random.randint random.choice random.choices random.uniform random.triangular random.randbytes random.sample random.getrandbits"),
    ("B312", "Call", "HIGH", 319, "telnetlib.Telnet"),
    ("B313", "Call", "MEDIUM", 20, "xml.etree.cElementTree.parse xml.etree.cElementTree.iterparse xml.etree.cElementTree.fromstring xml.etree.cElementTree.XMLParser"),
    ("B314", "Call", "MEDIUM", 20, "xml.etree.ElementTree.parse xml.etree.ElementTree.iterparse xml.etree.ElementTree.fromstring xml.etree.ElementTree.XMLParser"),
    ("B315", "Call", "MEDIUM", 20, "xml.sax.expatreader.create_parser"),
    ("B316", "Call", "MEDIUM", 20, "xml.dom.expatbuilder.parse xml.dom.expatbuilder.parseString"),
    ("B317", "Call", "MEDIUM", 20, "xml.sax.parse xml.sax.parseString xml.sax.make_parser"),
    ("B318", "Call", "MEDIUM", 20, "xml.dom.minidom.parse xml.dom.minidom.parseString"),
    ("B319", "Call", "MEDIUM", 20, "xml.dom.pulldom.parse xml.dom.pulldom.parseString"),
    ("B321", "Call", "HIGH", 319, "ftplib.FTP"),
    ("B323", "Call", "MEDIUM", 295, "ssl._create_unverified_context"),
    ("B401", "Import", "HIGH", 319, "telnetlib"),
    ("B402", "Import", "HIGH", 319, "ftplib"),
    ("B403", "Import", "LOW", 502, "pickle cPickle dill shelve"),
    ("B404", "Import", "LOW", 78, "subprocess"),
    ("B405", "Import", "LOW", 20, "xml.etree.cElementTree xml.etree.ElementTree"),
    ("B406", "Import", "LOW", 20, "xml.sax"),
    ("B407", "Import", "LOW", 20, "xml.dom.expatbuilder"),
    ("B408", "Import", "LOW", 20, "xml.dom.minidom"),
    ("B409", "Import", "LOW", 20, "xml.dom.pulldom"),
    ("B411", "Import", "HIGH", 20, "xmlrpc"),
    ("B412", "Import", "HIGH", 284, "wsgiref.handlers.CGIHandler twisted.web.twcgi.CGIScript twisted.web.twcgi.CGIDirectory"),
    ("B413", "Import", "HIGH", 327, "Crypto.Cipher Crypto.Hash Crypto.IO Crypto.Protocol Crypto.PublicKey Crypto.Random Crypto.Signature Crypto.Util"),
    ("B415", "Import", "HIGH", 319, "pyghmi"),
]
#: Attributes that change a class or its methods, and harmless ones (fixed values).
DANGEROUS = ("__class__", "__dict__", "__init__", "__new__", "__del__", "__getattr__", "__setattr__", "__delattr__", "__getattribute__", "__bases__", "__mro__", "__subclasses__", "__module__", "__name__", "__globals__", "__builtins__", "__code__", "__closure__", "__func__", "__self__", "__qualname__", "__annotations__", "__doc__", "__file__", "__package__", "__spec__")
SAFE = (
    "id", "name", "value", "data", "content", "text", "title", "description", "type", "kind", "status", "state", "level", "priority", "category", "version", "timestamp", "created", "updated", "modified", "author",
    "source", "target", "destination", "path", "url", "uri", "key", "get", "set", "add", "remove", "delete", "update", "create", "find", "search", "filter", "sort", "count", "length", "size", "empty",
    "config", "settings", "options", "params", "args", "kwargs", "default", "custom", "user", "system", "global", "local",
)


def _issue(rows: DataFrame, test: str, severity, confidence, cwe, text: Column | None = None) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select("file_id", "node_id", "lineno", "end_lineno", "col", F.lit(test).alias("test_id") if isinstance(test, str) else test.alias("test_id"), as_col(severity).alias("severity"), as_col(confidence).alias("confidence"), as_col(cwe).cast("int").alias("cwe"), (text if text is not None else F.col("qualname")).alias("ident"))


def _told(where: Column, test, severity, confidence, cwe: int, text: Column | None = None) -> Column:
    """An issue of a node where a condition holds, else null."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    found = F.struct(as_col(test).alias("test_id"), as_col(severity).alias("severity"), as_col(confidence).alias("confidence"), F.lit(cwe).alias("cwe"), (text if text is not None else F.col("qualname")).alias("ident"))
    return F.when(where, found)


def _arg(k: int, field: str) -> Column:
    return F.get(F.col("args"), k)[field]


def blacklist(spark) -> DataFrame:
    """(node_kind, name, seq, test_id, severity, cwe): the dimension of reported names."""
    rows = [(kind, n, i, t, s, c) for i, (t, kind, s, c, names) in enumerate(BLACKLIST) for n in names.split()]
    return spark.createDataFrame(rows, "node_kind string, ref string, seq int, test_id string, severity string, cwe int")


#: What the rules read of syntax nodes: kinds and columns.
KINDS = ("Call", "alias", "Import", "ImportFrom", "Constant", "FunctionDef", "Assign", "Attribute")
COLUMNS = ("file_id", "node_id", "parent_id", "field", "kind", "lineno", "end_lineno", "col", "name", "value", "value_kind", "qualname", "args", "kw", "context")


def run_rules(nodes: DataFrame, extra: list | None = None) -> DataFrame:
    """All issues (file_id, node_id, lineno, end_lineno, col, test_id, severity, confidence, cwe, ident) of ast_node rows.

    ``extra`` adds rules: functions from nodes to such rows.
    """
    spark = nodes.sparkSession
    calls = nodes.filter("kind = 'Call'")
    names = F.broadcast(blacklist(spark))  # a row for each fixed name
    hit = calls.join(names.filter("node_kind = 'Call'"), F.col("qualname") == F.col("ref"))
    first = hit.withColumn("_k", F.row_number().over(Window.partitionBy("file_id", "node_id").orderBy("seq"))).filter("_k = 1")
    under = nodes.filter("kind = 'alias'").join(nodes.filter("kind = 'Import'").select("file_id", F.col("node_id").alias("parent_id")), ["file_id", "parent_id"])
    brought = under.select("file_id", "node_id", "lineno", "end_lineno", "col", "name").unionByName(nodes.filter("kind = 'ImportFrom' and name is not null").select("file_id", "node_id", "lineno", "end_lineno", "col", "name"))
    imported = brought.join(names.filter("node_kind = 'Import'"), F.col("name") == F.col("ref")).withColumn("qualname", F.col("name"))
    call, kw = F.col("kind") == "Call", lambda k: F.element_at("kw", F.lit(k))
    named = lambda *names: call & F.col("qualname").isin(*names)
    secret = F.filter(F.map_entries("kw"), lambda e: e["value"].startswith("str:") & credential_name(e["key"]))
    default = F.filter("args", lambda x: (x["kind"] == "str") & credential_name(x["name"]))
    called = F.coalesce(F.when(_arg(1, "kind") == "str", _arg(1, "value")), F.when(_arg(1, "kind") == "Name", _arg(1, "name")), F.lit(""))  # a bare name counts by its own name
    level = (
        F.when(called.isin(*SAFE), None).when(called.isin(*DANGEROUS), "HIGH").when(_arg(1, "outside").isNotNull(), "HIGH")
        .when(_arg(1, "kind") == "Name", F.when(F.col("qualname") == "setattr", "MEDIUM").otherwise("LOW"))
    )
    merge = F.when(_arg(0, "outside") == "given", "HIGH").when(_arg(0, "kind") == "Name", "MEDIUM")
    short = kw("key_size").startswith("int:") & (F.substring(kw("key_size"), 5, 20).try_cast("int") < 128)
    replaced = (F.col("kind") == "Assign") & (F.col("value") == "__dict__") & _arg(0, "kind").isin("Name", "Dict", "Call") & F.col("value_kind").isNull()
    # What a node's own row tells, in one pass over the nodes: the issues that apply, none for most.
    own = [
        _told(named("exec"), "B102", "MEDIUM", "HIGH", 78),
        _told((F.col("kind") == "Constant") & (F.col("value_kind") == "str") & F.exists("context", credential_name), "B105", "LOW", "MEDIUM", 259, F.col("value")),
        _told(call & (F.size(secret) > 0), "B106", "LOW", "MEDIUM", 259, F.substring(F.get(secret, 0)["value"], 5, 1000)),
        _told((F.col("kind") == "FunctionDef") & (F.size(default) > 0), "B107", "LOW", "MEDIUM", 259, F.get(default, 0)["value"]),
        _told(named("Crypto.Cipher.AES.new", "AES.new") & short, "B303", "MEDIUM", "HIGH", 327),
        _told(named("hashlib.md5", "hashlib.sha1"), "B304", "MEDIUM", "HIGH", 327),
        _told(named("subprocess.Popen") & (kw("shell") == "bool:True"), "B602", "HIGH", "HIGH", 78),
        _told(named("os.system", "os.popen", "commands.getstatusoutput"), "B604", "HIGH", "HIGH", 78),
        _told(named("setattr", "getattr") & (F.size("args") >= 2) & level.isNotNull(), F.when(F.col("qualname") == "setattr", "B701").otherwise("B705"), "HIGH", level, 20),
        _told(named("dict.update", "object.__setattr__") & (F.size("args") >= 1) & merge.isNotNull(), "B702", "HIGH", merge, 20),
        _told(replaced, "B704", "HIGH", F.when(_arg(0, "outside") == "given", "HIGH").otherwise("MEDIUM"), 20, F.col("value")),
    ]
    local = nodes.select("file_id", "node_id", "lineno", "end_lineno", "col", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("i")).select("file_id", "node_id", "lineno", "end_lineno", "col", "i.*")
    # Whether a name space is handed to an update method, and whether that also gets input from outside first.
    updates = nodes.filter("kind = 'Attribute' and field = 'func' and name = 'update'").select("file_id", F.col("parent_id").alias("_u")).join(calls.select("file_id", F.col("node_id").alias("_u"), _arg(0, "outside").alias("_first")), ["file_id", "_u"])
    spaces = calls.filter(F.col("qualname").isin("vars", "globals", "locals")).withColumn("_u", F.when(F.col("field") == "args", F.col("parent_id"))).join(updates.withColumn("_in", F.lit(True)), ["file_id", "_u"], "left")
    spaces = spaces.withColumn("_s", F.when(F.col("_first") == "given", "HIGH").when(F.col("_in"), "MEDIUM").otherwise("LOW"))
    parts = [
        local,
        _issue(first, F.col("test_id"), F.col("severity"), "HIGH", F.col("cwe")),
        _issue(imported, F.col("test_id"), F.col("severity"), "HIGH", F.col("cwe")),
        _issue(spaces, "B706", "HIGH", F.col("_s"), 20),
        *(f(nodes) for f in extra or []),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suppressed(issues: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) by nosec comments: the first comment inside the node's lines decides, with that on the issue's own line.

    Lines of a node are listed, so this joins on equality. Both inputs are read twice: write them first.
    """
    lines = issues.select("file_id", "node_id", "test_id", "lineno", F.explode(F.sequence("lineno", F.coalesce("end_lineno", "lineno"))).alias("line"))
    near = lines.join(marks, ["file_id", "line"])
    first = near.groupBy("file_id", "node_id", "test_id").agg(F.min_by("ids", "line").alias("a"), F.max(F.when(F.col("line") == F.col("lineno"), F.col("ids"))).alias("b"))
    none = F.array().cast("array<string>")
    ids = F.array_union(F.coalesce("a", none), F.coalesce("b", none))
    gone = first.filter(F.coalesce("a", "b").isNotNull() & ((F.size(ids) == 0) | F.array_contains(ids, F.col("test_id")))).select("file_id", "node_id", "test_id")
    return issues.join(gone, ["file_id", "node_id", "test_id"], "left_anti"), issues.join(gone, ["file_id", "node_id", "test_id"], "left_semi")


def filtered(issues: DataFrame, severity: str = "LOW", confidence: str = "LOW") -> DataFrame:
    return issues.filter(rank_at_least(F.col("severity"), severity) & rank_at_least(F.col("confidence"), confidence))


def metrics(issues: DataFrame) -> DataFrame:
    """(rank, issues, severity_score, confidence_score): counts and weighted scores by rank."""
    weight = lambda c: F.coalesce(*[F.when(F.col(c) == k, w) for k, w in WEIGHTS.items()], F.lit(0))
    s = issues.groupBy(F.col("severity").alias("rank")).agg(F.count("*").alias("issues"), F.sum(weight("severity")).alias("severity_score"))
    c = issues.groupBy(F.col("confidence").alias("rank")).agg(F.sum(weight("confidence")).alias("confidence_score"))
    return s.join(c, "rank", "full").fillna(0)


def json_report(issues: DataFrame) -> DataFrame:
    """One JSON line for each issue, in order."""
    fields = F.struct("file_id", "test_id", "severity", "confidence", "cwe", cwe_link("cwe").alias("cwe_link"), "lineno", "col", "ident")
    return issues.orderBy("file_id", "lineno", "col", "test_id").select(F.to_json(fields).alias("line"))


def sarif_report(issues: DataFrame) -> DataFrame:
    """Results of a SARIF 2.1 run, one for each issue, and its rules: (part, json)."""
    level = F.when(F.col("severity") == "HIGH", "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("uri")).alias("artifactLocation"), F.struct(F.col("lineno").alias("startLine"), (F.col("col") + 1).alias("startColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("test_id").alias("ruleId"), level.alias("level"), F.struct(F.col("ident").alias("text")).alias("message"), F.array(place).alias("locations"))
    rules = issues.select("test_id", "cwe").distinct().select(F.lit("rule").alias("part"), F.to_json(F.struct(F.col("test_id").alias("id"), cwe_link("cwe").alias("helpUri"))).alias("json"))
    return rules.union(issues.select(F.lit("result"), F.to_json(result)))


def text_report(issues: DataFrame) -> DataFrame:
    line = F.format_string(">> Issue: [%s] severity %s, confidence %s, CWE-%s (%s)\n   Location: file %s, line %s", "test_id", "severity", "confidence", F.col("cwe").cast("string"), cwe_link("cwe"), F.col("file_id").cast("string"), F.col("lineno").cast("string"))
    return issues.orderBy("file_id", "lineno", "col", "test_id").select(line.alias("text"))
