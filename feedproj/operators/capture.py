"""Change capture: source edits and snapshots to versioned events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.functions.ids import event_checksum, time_ordered_id
from feedproj.functions.times import instant
from feedproj.operators.guards import AGGREGATE
from feedproj.operators.kinds import CONTENT_KINDS, Kinds
from feedproj.operators.skew import HOT_ROWS, number_within
from feedproj.schema import (
    ENVELOPE,
    EVENT_VERSION,
    POST_TYPES,
    PUBLIC_STATUSES,
    columns,
)


def is_public(status: Column) -> Column:
    return F.coalesce(status.isin(*PUBLIC_STATUSES), F.lit(False))


def classify_transition(old_status: Column, new_status: Column) -> Column:
    """``created`` on entering the public set, ``updated`` inside, ``deleted`` on leaving."""
    was, now = is_public(old_status), is_public(new_status)
    return F.when(now & ~was, "created").when(now & was, "updated").when(was & ~now, "deleted")


def in_scope(df: DataFrame, saves: bool = False) -> DataFrame:
    """Rows that may emit: supported post types and the category taxonomy.

    ``saves=True`` adds what only plain saves demand: no revisions, no autosaves,
    already public.
    """
    kept = df.where(
        F.col("post_type").isin(*POST_TYPES) | F.coalesce(F.col("taxonomy") == "category", F.lit(False))
    )
    if saves:
        kept = kept.where(
            ~F.coalesce(F.col("is_revision"), F.lit(False))
            & ~F.coalesce(F.col("is_autosave"), F.lit(False))
            & is_public(F.col("post_status"))
        )
    return kept


def derive_changes(old: DataFrame, new: DataFrame, key: str, kind: str, kinds: Kinds = CONTENT_KINDS) -> DataFrame:
    """Events between two source snapshots with columns ``key, status, checksum``.

    ``created``/``deleted`` follow the public set; ``updated`` needs a changed checksum.
    """
    before = old.select(key, F.col("status").alias("_old_status"), F.col("checksum").alias("_old_sum"))
    after = new.select(key, F.col("status").alias("_new_status"), F.col("checksum").alias("_new_sum"))
    verb = classify_transition(F.col("_old_status"), F.col("_new_status"))
    same = F.col("_old_sum").eqNullSafe(F.col("_new_sum"))
    return (
        before.join(after, key, "full_outer")
        .withColumn("action", verb)
        .where(F.col("action").isNotNull() & ~((F.col("action") == "updated") & same))
        .select(
            F.concat_ws(".", F.lit(kinds.spec(kind).domain), F.lit(kind), "action").alias("event_type"),
            F.col(key).cast("string").alias("aggregate_id"),
            F.coalesce("_new_status", "_old_status").alias("status"),
        )
    )


def collapse_request_emits(emits: DataFrame) -> DataFrame:
    """Within one request a transition silences saves and trashings of the same entity.

    ``emits``: request_id, post_id, hook (transition, save, trash, hard_delete), ...
    Hard deletes always emit, and so do saves and trashings without a transition.
    """
    entity = ["request_id", "post_id"]
    handled = (
        emits.where(F.col("hook") == "transition")
        .select(*entity)
        .distinct()
        .withColumn("_handled", F.lit(True))
    )
    quiet = F.col("_handled").isNotNull() & F.col("hook").isin("save", "trash")
    return emits.join(handled, entity, "left").where(~quiet).drop("_handled")


def assign_versions(
    events: DataFrame, counters: DataFrame, time: str = "created_at", tie: str = "seq",
    rows: int = HOT_ROWS,
) -> DataFrame:
    """``aggregate_version``: next numbers per aggregate after the stored counter."""
    numbered = number_within(events, AGGREGATE, [time, tie], "_next", rows)
    stored = counters.select(*AGGREGATE, F.col("current_version").alias("_base"))
    # Counters are one row per aggregate; AQE splits a hot aggregate on the events' side.
    return (
        numbered.join(stored, AGGREGATE, "left")
        .withColumn("aggregate_version", F.col("_next") + F.coalesce(F.col("_base"), F.lit(0)))
        .drop("_next", "_base")
    )


def next_counters(events: DataFrame, counters: DataFrame) -> DataFrame:
    """Counters after ``assign_versions``: the highest version per aggregate."""
    seen = events.groupBy(*AGGREGATE).agg(F.max("aggregate_version").alias("_seen"))
    return counters.join(seen, AGGREGATE, "full_outer").select(
        *AGGREGATE, F.greatest("current_version", "_seen").alias("current_version")
    )


def aggregate_type(event_type: Column, kinds: Kinds = CONTENT_KINDS) -> Column:
    """Second name segment when it is a registered kind."""
    return kinds.aggregate_type(event_type)


def post_payload(post_id: Column, post_type: Column, status: Column) -> Column:
    return F.to_json(
        F.struct(post_id.alias("post_id"), post_type.alias("post_type"), status.alias("status"))
    )


def build_envelope(changes: DataFrame, as_of, kinds: Kinds = CONTENT_KINDS) -> DataFrame:
    """Full event rows from versioned changes.

    Needs event_type, aggregate_id, aggregate_version, payload, created_at;
    source_updated_at, correlation_id and causation_id are optional. Times keep
    whole seconds. A root event is its own correlation id.
    """
    now = instant(as_of)
    have = set(changes.columns)

    def optional(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    captured = F.date_trunc("second", F.col("created_at").cast("timestamp"))
    seed = F.concat_ws(":", "event_type", "aggregate_id", F.col("aggregate_version").cast("string"))
    built = {
        "id": time_ordered_id(F.col("created_at").cast("timestamp"), seed),
        "event_version": F.lit(EVENT_VERSION),
        "aggregate_type": aggregate_type(F.col("event_type"), kinds),
        "source_updated_at": F.date_trunc(
            "second", F.coalesce(optional("source_updated_at", "timestamp"), now)
        ),
        "checksum": event_checksum(F.col("payload")),
        "correlation_id": F.coalesce(
            optional("correlation_id", "string"),
            time_ordered_id(F.col("created_at").cast("timestamp"), seed),
        ),
        "causation_id": optional("causation_id", "string"),
        "created_at": captured,
    }
    return changes.select(*[built.get(c, F.col(c)).alias(c) for c in columns(ENVELOPE)])
