"""All queries of the library, and SQL for those that it can express."""

from __future__ import annotations

from . import analytics, anchored, compact, layers, relational, sequences, spanning, streams, subtrees, unions

MODULES = [relational, sequences, analytics, layers, subtrees, spanning, unions, streams, compact, anchored]
QUERIES = {name: f for m in MODULES for name, f in m.R.queries.items()}
SQL = {name: q for m in MODULES for name, q in m.R.sql.items()}
