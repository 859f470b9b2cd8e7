"""All registered queries with the SQL that their results must match."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``; ``sql`` is the same over the views of ``plans.views.WITH``."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from chronoloom.plans import queries_aggregates, queries_controls, queries_joins, queries_lockbox, queries_models, queries_panels, queries_policy, queries_replay, queries_reports, queries_scalars, queries_sequences, queries_stats, queries_streams, queries_sweeps, queries_ticks, queries_windows  # noqa: E402, F401
