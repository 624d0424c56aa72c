"""All queries over the driver's tables, each with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query under `name`; `sql` is its DuckDB twin."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> dict[str, Query]:
    from . import engine, evaluation, events, judging, lookups, pieces, relational, retrieval, structure, text  # noqa: F401  they register their queries

    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in _load().items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load()["dense_topk"].run(spark, sf_dir)
