"""Reading outboxes and event stores; small sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedproj.functions.shape import documents
from feedproj.operators.guards import new_by_id
from feedproj.schema import ENVELOPE, OUTBOX, columns


def _read(spark: SparkSession, path: str, ddl: str, fmt: str, stream: bool, **options) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).options(**options)
    if fmt == "jdbc":
        return reader.format("jdbc").load()
    return reader.schema(ddl).format(fmt).load(path)


def pending_first(outbox: DataFrame) -> DataFrame:
    """Pending rows, oldest first."""
    return outbox.where(F.col("status") == "pending").orderBy("created_at", "id")


def read_outbox(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Pending outbox rows; oldest first in a batch, in file order as a stream.

    ``fmt``: parquet, json, csv, orc or jdbc (url, dbtable and, to read in
    parallel, partitionColumn/lowerBound/upperBound/numPartitions as options).
    """
    rows = _read(spark, path, OUTBOX, fmt, stream, **options)
    return rows.where(F.col("status") == "pending") if stream else pending_first(rows)


def decoded(events: DataFrame) -> DataFrame:
    """Full envelopes with ``payload_map``; a payload that is no JSON object is empty."""
    empty = F.create_map().cast("map<string,string>")
    body = F.from_json("payload", "map<string,string>", {"mode": "PERMISSIVE"})
    return events.select(*columns(ENVELOPE), F.coalesce(body, empty).alias("payload_map"))


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    return decoded(_read(spark, path, ENVELOPE, fmt, stream, **options))


def append_events(new: DataFrame, store: DataFrame) -> DataFrame:
    """Rows to append: one per id the store does not hold, whichever order the copies come in."""
    return new_by_id(new, store, "id")


def write_events(new: DataFrame, path: str) -> None:
    """Append to a parquet event store, by aggregate type."""
    new.write.mode("append").partitionBy("aggregate_type").parquet(path)


def write_dead_letters(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_collection(df: DataFrame, kind: str, path: str) -> None:
    """Shaped rows as one JSON document per line."""
    documents(df, kind).select("document").write.mode("overwrite").text(path)
