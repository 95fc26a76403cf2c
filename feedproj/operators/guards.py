"""Relay, dispatch and the guards in front of the apply step.

``ledger`` answers "was this very event applied?", ``versions`` answers "is it
older than what is applied?". They stay two tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.functions.times import instant
from feedproj.operators.kinds import CONTENT_KINDS, Kinds
from feedproj.operators.skew import HOT_ROWS, salted_lookup
from feedproj.schema import ENVELOPE, PARTITIONS, columns

AGGREGATE = ["aggregate_type", "aggregate_id"]


# --- event type names -------------------------------------------------------

def valid_event_type(col: Column) -> Column:
    """``<domain>.<aggregate>.<action>``: at least three non-empty dotted segments."""
    return F.coalesce(col.rlike(r"^[^.]+(\.[^.]+){2,}$"), F.lit(False))


def registered(col: Column, kinds: Kinds = CONTENT_KINDS) -> Column:
    """Whether a registered kind declares the type."""
    return kinds.registered(col)


def action(col: Column, kinds: Kinds = CONTENT_KINDS) -> Column:
    """``upsert`` or ``tombstone``, as the type's kind declares; NULL for unknown types."""
    return kinds.action(col)


def partition_of(col: Column) -> Column:
    """Feed partition of an event; NULL when its domain is not a known partition."""
    domain = F.split_part(col, F.lit("."), F.lit(1))
    return F.when(domain.isin(*PARTITIONS), domain)


# --- relay ------------------------------------------------------------------

def relayed_envelopes(outbox: DataFrame) -> DataFrame:
    """Outbox rows as event-store rows: ids and capture time kept, blank parents NULL."""
    typed = {
        "event_version": F.col("event_version").cast("int"),
        "aggregate_version": F.col("aggregate_version").cast("bigint"),
        "source_updated_at": F.col("source_updated_at").cast("timestamp"),
        "created_at": F.col("created_at").cast("timestamp"),
        "causation_id": F.nullif(F.col("causation_id"), F.lit("")),
    }
    return outbox.select(*[typed.get(c, F.col(c)).alias(c) for c in columns(ENVELOPE)])


def one_copy(rows: DataFrame, key: str = "id", *more: Column) -> DataFrame:
    """One whole row per ``key``, with ``more`` aggregates over its copies.

    Of copies that differ the least stays: by aggregate version, then capture time, then
    all other columns. So no task order and no retry can change which, and no row is put
    together from several. Copies are reduced inside each task before they move.
    """
    first = [c for c in ("aggregate_version", "created_at") if c in rows.columns and c != key]
    rest = [*first, *[c for c in rows.columns if c not in (key, *first)]]
    if not rest:
        return rows.groupBy(key).agg(*more) if more else rows.distinct()
    out = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"), *more)
    added = [c for c in out.columns if c not in (key, "_row")]
    return out.select(*[F.col(c) if c == key else F.col(f"_row.{c}") for c in rows.columns], *added)


def new_by_id(rows: DataFrame, stored: DataFrame, key: str, stored_key: str | None = None) -> DataFrame:
    """Rows whose id is not stored yet, one per id (see :func:`one_copy`)."""
    known = stored.select(F.col(stored_key or key).alias(key))
    return one_copy(rows, key).join(known, key, "left_anti")


def relay(outbox: DataFrame, events: DataFrame) -> DataFrame:
    """The rows to append to the event store for all pending outbox rows."""
    pending = outbox.where(F.col("status") == "pending")
    return new_by_id(relayed_envelopes(pending), events, "id")


def mark_relayed(outbox: DataFrame, relayed_ids: DataFrame, as_of) -> DataFrame:
    ids = relayed_ids.select("id").distinct().withColumn("_done", F.lit(True))
    now = F.col("_done").isNotNull() & (F.col("status") == "pending")
    return (
        outbox.join(ids, "id", "left")
        .withColumn("relayed_at", F.when(now, instant(as_of)).otherwise(F.col("relayed_at").cast("timestamp")))
        .withColumn("status", F.when(now, "relayed").otherwise(F.col("status")))
        .drop("_done")
    )


# --- dispatch ---------------------------------------------------------------

def undispatched(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Events no job was ever made for; finished jobs count as seen."""
    return events.join(seen.select(F.col("event_id").alias("id")), "id", "left_anti")


def oldest_first(df: DataFrame, n: int, time: str = "created_at", tie: str = "id") -> DataFrame:
    return df.orderBy(time, tie).limit(n)


def route(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed with ``queue_name``, events of no known partition)."""
    named = events.withColumn("queue_name", partition_of(F.col("event_type")))
    return named.where("queue_name IS NOT NULL"), named.where("queue_name IS NULL")


# --- guards -----------------------------------------------------------------

def dedup_exact(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per event id that the ledger does not hold.

    Copies of an event collapse before the shuffle, so an id delivered millions
    of times is still one row by the time it moves.
    """
    return new_by_id(events, ledger, "id", "event_id")


def with_latest(events: DataFrame, versions: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """Each event with ``latest``, the version already applied for its aggregate."""
    touched = events.groupBy(*AGGREGATE).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    stored = versions.select(*AGGREGATE, F.col("latest_processed_version").alias("latest"))
    latest = touched.join(stored, AGGREGATE, "left")
    return salted_lookup(events, latest, AGGREGATE, ["id"], rows)


def is_fresh() -> Column:
    """Nothing applied yet, or strictly newer than what is."""
    return F.col("latest").isNull() | (F.col("aggregate_version") > F.col("latest"))


def stale_guard(
    events: DataFrame, versions: DataFrame, rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(fresh, stale). A stale event is acknowledged and writes nothing at all."""
    known = with_latest(events, versions, rows)
    return known.where(is_fresh()).drop("latest"), known.where(~is_fresh()).drop("latest")


def split_actions(events: DataFrame, kinds: Kinds = CONTENT_KINDS) -> tuple[DataFrame, DataFrame]:
    kind = action(F.col("event_type"), kinds)
    return events.where(kind == "upsert"), events.where(kind == "tombstone")


def reject_unregistered(events: DataFrame, kinds: Kinds = CONTENT_KINDS) -> tuple[DataFrame, DataFrame]:
    """(registered, failures): an unknown type is a failure, not a skip."""
    ok = registered(F.col("event_type"), kinds)
    return events.where(ok), events.where(~ok).withColumn("failure_reason", F.lit("unregistered"))


def reject_orphans(upserts: DataFrame, source: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(with a source row, failures without one); ``source`` is unique on ``key``."""
    wanted = F.col("aggregate_id").try_cast("bigint")
    keyed = upserts.withColumn(key, wanted)
    present = source.select(key).withColumn("_present", F.lit(True))
    joined = salted_lookup(keyed, present, [key], ["id"])
    found = joined.where("_present").drop("_present", key)
    lost = joined.where("_present IS NULL").drop("_present", key)
    return found, lost.withColumn("failure_reason", F.lit("orphan"))


def reject_missing_event(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs that point at no stored event."""
    ids = events.select(F.col("id").alias("event_id"))
    return jobs.join(ids, "event_id", "left_anti").withColumn("failure_reason", F.lit("missing_event"))


def reduce_aggregates(fresh: DataFrame, kinds: Kinds = CONTENT_KINDS) -> DataFrame:
    """One row per aggregate with all the apply step needs to know about its events.

    ``min_u``/``max_u`` lowest and highest upsert version, ``max_d`` highest
    tombstone version, ``t_d`` that tombstone's source time. Every aggregate has a
    fixed-size buffer, so tasks reduce by hash before the shuffle.
    """
    kind = action(F.col("event_type"), kinds)
    version = F.col("aggregate_version")
    up = F.when(kind == "upsert", version)
    down = F.when(kind == "tombstone", version)
    return fresh.groupBy(*AGGREGATE).agg(
        F.min(up).alias("min_u"),
        F.max(up).alias("max_u"),
        F.max(down).alias("max_d"),
        F.max_by("source_updated_at", down).alias("t_d"),
        F.count(F.lit(1)).alias("n_events"),
    )


def latest_per_aggregate(events: DataFrame) -> DataFrame:
    """The newest event of each aggregate, whole row, reduced before the shuffle."""
    rest = [c for c in events.columns if c not in AGGREGATE]
    newest = F.max_by(F.struct(*rest), F.struct("aggregate_version", "id")).alias("_row")
    return events.groupBy(*AGGREGATE).agg(newest).select(*AGGREGATE, *[f"_row.{c}" for c in rest])
