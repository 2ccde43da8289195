"""All queries over the shared tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from tessera.plans import event_queries, evidence_queries, identity_queries, pair_queries, report_queries, vector_queries  # noqa: F401
from tessera.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "mutual_best_pairs"
