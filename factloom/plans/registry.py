"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import NAMES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return table(self.spark, self._dir, name)


def query(sql: str | None = None):
    """Registers plan(t: Tables) under its name."""

    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return register


def same_sql(name: str, sql: str, *tables: str, spark_sql: str | None = None) -> None:
    """A plan that both engines take as SQL."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql((spark_sql or sql).format(**{t: f"{{{t}}}" for t in tables}), **{t: table(spark, sf_dir, t) for t in tables})

    QUERIES[name] = plan
    ORACLES[name] = sql.format(**{t: t for t in tables})
