"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from speakerprint.operators.scale import spread_scan
from speakerprint.session import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("conversation_queries", "fingerprint_queries", "experiment_queries", "trial_queries", "registry_queries", "archive_queries", "stream_queries", "style_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the expected result in DuckDB's dialect."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


#: Tables of long texts or JSON and the key they are spread by when a scan is too narrow.
WIDE_TABLES = {"documents": "doc_id", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, spread over the cores when its scan has too few partitions."""
    return spread_scan(table(spark, sf_dir, name).select(*columns), WIDE_TABLES[name])


def _load() -> None:
    for m in MODULES:
        import_module(f"speakerprint.plans.{m}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
