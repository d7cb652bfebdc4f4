"""Named queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from molframe.plans import q_basic, q_cluster, q_commands, q_consensus, q_more

FLAGSHIP = "family_sizes_identity"
_PARTS = (q_basic, q_cluster, q_consensus, q_more, q_commands)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
