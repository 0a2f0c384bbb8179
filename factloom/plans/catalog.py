"""All core queries by name, and the SQL twin of each that SQL can express."""

from __future__ import annotations

from . import problems, reporting, retrieval, store, writing

PARTS = (store, retrieval, writing, reporting, problems)
QUERIES: dict = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in PARTS for name, sql in getattr(part, "ORACLE", {}).items()}
FLAGSHIP = "hybrid_rank"
