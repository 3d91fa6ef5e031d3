"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotwise.plans import queries as registered
from slotwise.plans import binding_queries, carry_queries, chain_queries, ledger_queries, more_queries, population_queries, state_queries, trust_queries, wire_queries  # noqa: F401  (they register their queries)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: registered.QUERIES[name] for name in registered.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered.flagship(spark, sf_dir)
