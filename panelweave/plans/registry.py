"""Named queries: a Spark plan over the given tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from panelweave.functions.numbers import half_up
from panelweave.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables by name, read as parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(tune(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def text_tasks(spark: SparkSession) -> int | None:
    """Tasks over which the session wants texts dealt before heavy row-local work, for sources that
    are read in too few; None, the default, leaves the source's own tasks."""
    asked = spark.conf.get("spark.panelweave.textTasks", None)
    return int(asked) if asked else None


def rnd(value: Column, digits: int = 4) -> Column:
    return half_up(value, digits)


def sql_rnd(expr: str, digits: int = 4) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


def sql_hash(seed, *cols: str) -> str:
    return f"md5(concat_ws(':', '{seed}', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


def sql_unit(hashed: str) -> str:
    """First 8 hex digits of a hash as an integer."""
    return f"CAST(concat('0x', substr({hashed}, 1, 8)) AS BIGINT)"
