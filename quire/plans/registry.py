"""All registered queries and oracles."""

from __future__ import annotations

from quire.plans import queries_catalog, queries_layout, queries_ledger, queries_memory, queries_model, queries_reading, queries_streaming

_PARTS = [queries_model, queries_memory, queries_catalog, queries_ledger, queries_reading, queries_layout, queries_streaming]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in _PARTS:
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
