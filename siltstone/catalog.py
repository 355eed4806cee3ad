"""All queries of the engine, one or more for each operator family."""

from __future__ import annotations

from siltstone.plans import aggregates, complete, duplicates, evaluation, exchange, further, graphs, indexes, learned, matching, merges, more, networks, quality, relational, retrieval, scalars, selection, statements, storage, streams, structure, versions  # noqa: F401
from siltstone.registry import ORACLE_SQL, QUERIES  # noqa: F401
