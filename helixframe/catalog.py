"""Registry of the library's own queries and their SQL equivalents."""

from __future__ import annotations

from helixframe.plans import oracles, queries as _queries


def queries() -> dict[str, _queries.Query]:
    return _queries.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
