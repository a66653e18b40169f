"""Registry of the library's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import corpus, digests, knowledge, scenarios, tables

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (corpus, tables, knowledge, digests, scenarios)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
