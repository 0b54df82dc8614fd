"""All queries of the trade library and their SQL."""

from __future__ import annotations

from . import base, jobs, judgement, raw, streams

MODULES = (base, jobs, judgement, raw, streams)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.C.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.C.sql.items()}
