"""Each security rule over one file for each part: the files go through all rules, all reported names and the ways to suppress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from .base import query, table
from .programs import judged

_IMPORTS = {n: (t, s, c) for t, kind, s, c, names in rules.BLACKLIST if kind == "Import" for n in names.split()}


def _imported(module: str, line: int = 1) -> list[tuple]:
    found = _IMPORTS.get(module)
    return [(found[0], line, found[1], "HIGH", found[2])] if found else []


def _cases() -> list[tuple[str, list[tuple]]]:
    """(text, issues as (test, line, severity, confidence, cwe)) of each file."""
    out = []
    for test, kind, severity, cwe, names in rules.BLACKLIST:
        for name in names.split():
            module, _, last = name.rpartition(".")
            if kind == "Import":
                out.append((f"import json, {name} as other\n", [(test, 1, severity, "HIGH", cwe)]))
                out.append((f"from {name} import thing\n", [(test, 1, severity, "HIGH", cwe)]))
            elif module:
                out.append((f"from {module} import {last} as used\n\n\ndef run(x):\n    return used(x)\n", [*_imported(module), (test, 5, severity, "HIGH", cwe)]))
                out.append((f"import {module}\n\n{name}(\n    1)\n", [*_imported(module), (test, 3, severity, "HIGH", cwe)]))
            else:
                out.append((f"{name}(x)\n", [(test, 1, severity, "HIGH", cwe)]))
    secret = lambda test, line: (test, line, "LOW", "MEDIUM", 259)
    unsafe = lambda test, line, confidence: (test, line, "HIGH", confidence, 20)
    shell = lambda test, line: (test, line, "HIGH", "HIGH", 78)
    weak = lambda test, line: (test, line, "MEDIUM", "HIGH", 327)
    ran = lambda line: ("B102", line, "MEDIUM", "HIGH", 78)
    out += [
        ("exec(a)\n", [ran(1)]), ("def f(a):\n    if a:\n        exec(\n            a)\n", [ran(3)]), ("self.exec(a)\n", []),
        ("password = 'x'\n", [secret("B105", 1)]), ("conf.db_pwd = 'x'\n", [secret("B105", 1)]), ("conf['token'] = 'x'\n", [secret("B105", 1)]), ("if passphrase == 'x':\n    pass\n", [secret("B105", 1)]),
        ("passing = 'x'\n", []), ("password = 1\n", []), ("token\n'token'\n", []), ("conf['token'] = y\n", []),
        ("login('u', password='x', token='y')\n", [secret("B106", 1)]), ("login(password=p)\n", []), ("login(word='x')\n", []),
        ("def f(user, password='x'):\n    pass\n", [secret("B107", 1)]), ("def f(password, user='x'):\n    pass\n", []), ("def f(*, password='x'):\n    pass\n", []),
        ("from Crypto.Cipher import AES\nAES.new(k, key_size=64)\n", [*_imported("Crypto.Cipher"), weak("B303", 2)]), ("AES.new(k, key_size=128)\n", []), ("import AES\nAES.new(k, key_size=40)\n", [weak("B303", 2)]),
        ("import hashlib\nhashlib.md5(b)\n", [weak("B304", 2)]), ("from hashlib import sha1 as s\ns(b)\n", [weak("B304", 2)]), ("import hashlib\nhashlib.sha256(b)\n", []),
        ("import subprocess\nsubprocess.Popen(c, shell=True)\n", [*_imported("subprocess"), shell("B602", 2)]), ("import subprocess\nsubprocess.Popen(c, shell=False)\nsubprocess.call(c)\n", _imported("subprocess")),
        ("import os\nos.system(c)\nos.popen(c)\n", [shell("B604", 2), shell("B604", 3)]), ("import commands as c\nc.getstatusoutput(x)\n", [shell("B604", 2)]),
        ("cursor.execute('select * from t where a = ' + b)\n", []),
        ("setattr(o, '__class__', v)\n", [unsafe("B701", 1, "HIGH")]), ("setattr(o, request, v)\n", [unsafe("B701", 1, "HIGH")]), ("setattr(o, n, v)\n", [unsafe("B701", 1, "MEDIUM")]), ("setattr(o, name, v)\n", []),
        ("setattr(o, 'x' + form.get('k'), v)\n", [unsafe("B701", 1, "HIGH")]), ("setattr(o, '{}'.format(user_input), v)\n", [unsafe("B701", 1, "HIGH")]), ("setattr(o, 'title', v)\nsetattr(o, 'plain', v)\n", []),
        ("dict.update(params)\n", [unsafe("B702", 1, "HIGH")]), ("dict.update(m)\n", [unsafe("B702", 1, "MEDIUM")]), ("object.__setattr__(request.args, 'a', 1)\n", [unsafe("B702", 1, "HIGH")]), ("dict.update({})\n", []),
        ("o.__dict__.update(params)\n", []),
        ("o.__dict__ = m\n", [unsafe("B704", 1, "MEDIUM")]), ("o.__dict__ = request.get('a')\n", [unsafe("B704", 1, "HIGH")]), ("o.__dict__ = {}\n", [unsafe("B704", 1, "MEDIUM")]), ("o.__dict__ = 1\n", []), ("o.__dict__[k] = m\n", []),
        ("if allowed == m:\n    o.__dict__ = m\n", []), ("if s.verify(m):\n    o.__dict__ = m\n", []), ("if m:\n    o.__dict__ = m\n", [unsafe("B704", 2, "MEDIUM")]),
        ("getattr(o, '__globals__')\n", [unsafe("B705", 1, "HIGH")]), ("getattr(o, query_name)\n", [unsafe("B705", 1, "HIGH")]), ("getattr(o, n)\n", [unsafe("B705", 1, "LOW")]), ("getattr(o, 'value')\ngetattr(o)\n", []),
        ("vars(o)\nglobals()\n", [unsafe("B706", 1, "LOW"), unsafe("B706", 2, "LOW")]), ("locals().update(data)\n", [unsafe("B706", 1, "LOW")]),
        ("d.update(vars(o))\nf().update(1, globals())\nupdate(vars(o))\nd.update(k=vars(o))\n", [unsafe("B706", 1, "MEDIUM"), unsafe("B706", 2, "MEDIUM"), unsafe("B706", 3, "LOW"), unsafe("B706", 4, "LOW")]), ("d.update(data, vars(o))\n", [unsafe("B706", 1, "HIGH")]),
        ("exec(a)  # nosec\n", []), ("exec(a)  # nosec: B102\n", []), ("exec(a)  # nosec: B301\n", [ran(1)]), ("exec(a)  # nosec: exec_used\n", [ran(1)]), ("exec(a)  # nosec B301 B102\n", []), ("exec(a)  # nosec B102,B301\n", [ran(1)]),
        ("exec(  # first\n    a)  # nosec\n", [ran(1)]), ("exec(\n    a)  # nosec\n", []), ("# nosec\nexec(a)\n", [ran(2)]), ("exec(a\n", []),
    ]
    return out


CASES = _cases()
_VALUES = ", ".join(f"({k}, '{t}', {line}, '{s}', '{c}', {cwe})" for k, (_, found) in enumerate(CASES) for t, line, s, c, cwe in found)
_EXPECTED = f"SELECT p_partkey AS file_id, lineno, test_id, severity, confidence, cwe FROM part JOIN (VALUES {_VALUES}) AS e(k, test_id, lineno, severity, confidence, cwe) ON p_partkey % {len(CASES)} = k"


def files(spark, sf_dir):
    """(file_id, path, text): each part has the file of one case."""
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k long, text string")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), (F.col("p_partkey") % len(CASES)).alias("k"))
    return p.join(F.broadcast(texts), "k").select("file_id", F.format_string("audit/f_%d.py", "file_id").alias("path"), "text")


def issues(spark, sf_dir):
    return judged(files(spark, sf_dir))[0].select("file_id", "lineno", "test_id", "severity", "confidence", "cwe")


def _rule(name: str, tests: list[str]) -> None:
    listed = ", ".join(f"'{t}'" for t in tests)

    @query(name, f"SELECT * FROM ({_EXPECTED}) WHERE test_id IN ({listed})")
    def one(spark, sf_dir):
        return issues(spark, sf_dir).filter(F.col("test_id").isin(*tests))


_LISTED = list(dict.fromkeys(t for t, *_ in rules.BLACKLIST))
_DONE = {"B102", "B105", "B301", "B403", "B404", "B602"}
for _t in [*(t for t in _LISTED if t not in _DONE), "B106", "B107", "B604", "B701", "B702", "B704", "B705", "B706"]:
    _rule(_t.lower(), [_t])
_rule("b301_b323_calls", [t for t in _LISTED if t < "B4"])
_rule("b401_b415_imports", [t for t in _LISTED if t > "B4"])
_rule("b603_b608_b609_b703_silent", ["B603", "B608", "B609", "B703"])


@query("audit_all", _EXPECTED)
def audit_all(spark, sf_dir):
    """All rules and suppressions over all files."""
    return issues(spark, sf_dir)


@query("joi07_ids", f"SELECT p_partkey AS file_id, CAST(count(e.k) AS BIGINT) AS kept FROM part LEFT JOIN (VALUES {_VALUES}) AS e(k, test_id, lineno, severity, confidence, cwe) ON p_partkey % {len(CASES)} = e.k AND test_id = 'B102' WHERE p_partkey % {len(CASES)} IN (SELECT k FROM (VALUES {', '.join(f'({k})' for k, (t, _) in enumerate(CASES) if 'nosec' in t)}) AS n(k)) GROUP BY p_partkey")
def suppressed_by_id(spark, sf_dir):
    """How many issues stay in files with nosec comments, with or without test ids."""
    f = files(spark, sf_dir).filter(F.col("text").contains("nosec"))
    kept = judged(f)[0].filter("test_id = 'B102'").groupBy("file_id").agg(F.count("*").alias("kept"))
    return f.select("file_id").join(kept, "file_id", "left").fillna(0, ["kept"])
