"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from . import analyses, audit, between, bodies, calls, flows, graphs, ingestion, more, programs, relational, scalars, services, shapes, structure  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "win01"
