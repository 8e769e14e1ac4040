"""All named queries of the library with the SQL that must give the same rows."""

from __future__ import annotations

from . import answers, extras, library, more, retrieval, scalars, structure  # noqa: F401
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "f19_retrieve"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
