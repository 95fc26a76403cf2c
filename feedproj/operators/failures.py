"""Failure routing: retry schedule, dead letters, redrive.

The attempts table (event_id, queue_name, attempts, available_at, deadline,
last_error) takes the place of leased jobs: failures are rows, not exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.functions.ids import surrogate_id
from feedproj.functions.text import coerce_snapshot
from feedproj.functions.times import instant
from feedproj.schema import (
    BACKOFF_BASE_SECONDS,
    BACKOFF_CAP_SECONDS,
    FAILURES,
    JITTER_SHARE,
    PARTITIONS,
    RETRY_LIMIT,
)


def check_partition(name: str) -> str:
    if name not in PARTITIONS:
        raise ValueError(f"unknown partition {name!r}; valid: {', '.join(PARTITIONS)}")
    return name


def backoff_base(attempt: Column) -> Column:
    """Delay before jitter: doubles from 30 s, at most an hour; 0 before the first attempt."""
    # Beyond 20 doublings the cap holds anyway; the bound keeps the power small.
    doubled = F.pow(F.lit(2.0), F.least(attempt, F.lit(20)) - 1) * BACKOFF_BASE_SECONDS
    capped = F.least(doubled, F.lit(float(BACKOFF_CAP_SECONDS))).cast("int")
    return F.when(attempt > 0, capped).otherwise(F.lit(0))


def backoff_seconds(attempt: Column, key: Column) -> Column:
    """Delay with up to a quarter of jitter on top, from a hash so that it repeats."""
    base = backoff_base(attempt)
    room = F.floor(base * JITTER_SHARE).cast("bigint") + 1
    return (base + F.pmod(F.xxhash64(key, attempt), room)).cast("int")


def schedule_retry(failed: DataFrame, attempts: DataFrame, as_of) -> DataFrame:
    """Failed events with their next attempt number and due time.

    ``failed``: event_id, queue_name, failure_reason.
    """
    before = attempts.select("event_id", F.col("attempts").alias("_before"))
    tried = F.coalesce(F.col("_before"), F.lit(0)) + 1
    return (
        failed.join(before, "event_id", "left")
        .withColumn("attempts", tried.cast("int"))
        .withColumn(
            "available_at",
            F.timestamp_seconds(
                F.unix_seconds(instant(as_of)) + backoff_seconds(F.col("attempts"), F.col("event_id"))
            ),
        )
        .select(
            "event_id", "queue_name", "attempts", "available_at",
            F.lit(None).cast("timestamp").alias("deadline"),
            F.col("failure_reason").alias("last_error"),
        )
    )


def split_exhausted(scheduled: DataFrame, limit: int = RETRY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(to retry, to dead letter): the limit-th failed attempt is the last."""
    return scheduled.where(F.col("attempts") < limit), scheduled.where(F.col("attempts") >= limit)


def eligible(attempts: DataFrame, as_of, partition: str, n: int | None = None) -> DataFrame:
    """Due retries of one partition, oldest first."""
    due = attempts.where(
        (F.col("queue_name") == check_partition(partition)) & (F.col("available_at") <= instant(as_of))
    ).orderBy("available_at", "event_id")
    return due if n is None else due.limit(n)


def expired(attempts: DataFrame, as_of, partition: str) -> DataFrame:
    """Attempts table with work past its deadline made eligible again."""
    late = (F.col("queue_name") == check_partition(partition)) & F.coalesce(
        F.col("deadline") < instant(as_of), F.lit(False)
    )
    return (
        attempts.withColumn("available_at", F.when(late, instant(as_of)).otherwise(F.col("available_at")))
        .withColumn("deadline", F.when(late, F.lit(None).cast("timestamp")).otherwise(F.col("deadline")))
    )


def dead_letter_rows(exhausted: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Self-contained failure records with a snapshot of the event's payload.

    The event store is filtered to the few ids that failed before anything of it moves:
    their list is broadcast where it is small, as Spark sees by its size.
    """
    payloads = events.select(F.col("id").alias("event_id"), "payload").join(
        exhausted.select("event_id"), "event_id", "left_semi")
    return exhausted.join(payloads, "event_id", "left").select(
        surrogate_id("dead", F.concat_ws(":", "event_id", F.col("attempts").cast("string"))).alias("id"),
        "event_id",
        F.coalesce("last_error", F.lit("unknown")).alias("failure_reason"),
        F.col("attempts").alias("attempt_count"),
        coerce_snapshot(F.col("payload")).alias("payload_snapshot"),
        instant(as_of).alias("created_at"),
    )


def redrive(dead_letters: DataFrame, events: DataFrame) -> DataFrame:
    """A new batch of the stored events behind dead letters."""
    ids = dead_letters.select(F.col("event_id").alias("id"))
    return events.join(ids, "id", "left_semi")


def route_failures(outcomes: DataFrame, events: DataFrame, attempts: DataFrame, as_of,
                   limit: int = RETRY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(attempts table afterwards, new dead letters) for one batch's outcomes.

    Events that came through leave the attempts table.
    """
    domain = F.split_part("event_type", F.lit("."), F.lit(1))
    failed = outcomes.where(F.col("outcome").isin(*FAILURES)).select(
        F.col("id").alias("event_id"),
        # A domain that has no partition of its own is retried with the content.
        F.when(domain.isin(*PARTITIONS), domain).otherwise(F.lit("content")).alias("queue_name"),
        F.col("outcome").alias("failure_reason"),
    )
    retry, dead = split_exhausted(schedule_retry(failed, attempts, as_of), limit)
    seen = outcomes.select(F.col("id").alias("event_id"))
    waiting = attempts.join(seen, "event_id", "left_anti").select(*retry.columns)
    return waiting.unionByName(retry), dead_letter_rows(dead, events, as_of)
