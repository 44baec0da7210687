"""Functions on names, paths and patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that suggest a credential (fixed values).
CREDENTIAL_WORDS = "(pas+wo?r?d|pass(phrase)?|pwd|token|secrete?)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression for rlike."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"^(?s:{out})$"


def glob_match(name, pattern: str) -> Column:
    """Equality, or a match if the pattern has a wildcard."""
    return _col(name).rlike(glob_regex(pattern)) if any(c in pattern for c in "*?[") else _col(name) == F.lit(pattern)


def credential_name(name) -> Column:
    """Whether a name is one of the credential words, alone or between underscores."""
    w = CREDENTIAL_WORDS
    return _col(name).rlike(f"(?i)(^{w}$|_{w}_|^{w}_|_{w}$)")


def module_name(path) -> Column:
    """The dotted module of a source path; a package's own file names the package."""
    s = F.regexp_replace(F.regexp_replace(_col(path), r"^\./", ""), r"\.py$", "")
    return F.regexp_replace(F.regexp_replace(s, r"(^|/)__init__$", ""), "/", ".")


def cwe_link(cwe) -> Column:
    """The address of a weakness; empty for none."""
    return F.when(_col(cwe).isNull() | (_col(cwe) == 0), F.lit("")).otherwise(F.format_string("https://cwe.mitre.org/data/definitions/%s.html", _col(cwe).cast("string")))


def escape_markup(text) -> Column:
    out = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def base_name(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def dir_name(path) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)
