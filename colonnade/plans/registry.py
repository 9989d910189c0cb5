"""Registration of queries over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[["Tables"], DataFrame]

_plans: dict[str, Plan] = {}
_sql: dict[str, str] = {}


class Tables:
    """The tables of one folder, as attributes: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` is the same result in ANSI SQL."""

    def register(plan: Plan) -> Plan:
        if name in _plans:
            raise ValueError(f"query {name!r} is registered twice")
        _plans[name] = plan
        if sql is not None:
            _sql[name] = sql
        return plan

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plan(Tables(spark, folder))

    return {name: bound(plan) for name, plan in _plans.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
