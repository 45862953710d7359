"""Queries by name and their SQL, as the modules of this package register them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placestream.sources.adapters import ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *inputs: str):
    """Register a query; ``inputs`` are adapters put before the SQL, which begins with a CTE or select."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ctes(*inputs) if inputs else ""
            body = sql.strip()
            if head:
                body = f"with {head}, {body[5:]}" if body[:5].lower() == "with " else f"with {head} {body}"
            ORACLES[f.__name__] = body
        return f

    return keep


def r6(c, name: str | None = None):
    """Rounded to six decimals, after all comparisons."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6)
    return out.alias(name) if name else out
