"""Registry of named plans and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql``
    is the equivalent DuckDB query over the driver's views (None when the
    operator is not expressible in SQL, e.g. a fitted model)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def R6(expr: str, digits: int = 6) -> str:
    """SQL twin of ``bindings.r6``: canonicalise to ``min(9, digits + 4)``
    places as a DECIMAL, round half away from zero to ``digits``, back to
    DOUBLE (no -0.0)."""
    canon = min(9, digits + 4)
    return (f"CAST(round(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38, {canon})), {digits})"
            " AS DOUBLE)")


def R2(expr: str) -> str:
    return R6(expr, 2)
