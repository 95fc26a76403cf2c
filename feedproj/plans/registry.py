"""Named queries over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from feedproj.plans.fixtures import Tables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def wall_clock(df: DataFrame) -> DataFrame:
    """Timestamps as zone-free UTC wall clock, whatever zone the reader is in."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None):
    """Register ``run(tables)`` under ``name``; ``sql`` may name fixtures."""

    def keep(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: wall_clock(run(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return run

    return keep
