"""The register of queries and of the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_map(pairs) -> str:
    """A CASE over ``x``, the column that the caller puts in its place."""
    return "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + " ELSE NULL END"
