"""Projection tables: upsert, tombstone, bridge rewrite, ledger and versions.

The touched keys are split off by semi join and put back by union, so a batch
that is small next to the table is broadcast by size and the table is not
shuffled; a batch as large as the table becomes an ordinary shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.functions.ids import surrogate_id
from feedproj.functions.times import instant
from feedproj.operators.canonical import EntitySpec
from feedproj.operators.guards import AGGREGATE
from feedproj.operators.skew import salted_lookup
from feedproj.schema import columns


def replaced(current: DataFrame, rows: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """``current`` with all rows of the touched keys replaced by ``rows``."""
    gone = (rows if touched is None else touched).select(key)
    return current.join(gone, key, "left_anti").select(*rows.columns).unionByName(rows)


def suppress(canonical: DataFrame, current: DataFrame, spec: EntitySpec) -> DataFrame:
    """Add ``suppressed``: the stored row already carries the new checksum."""
    stored = current.select(
        F.col(spec.natural_key).alias(spec.key), F.col("checksum").alias("_stored")
    )
    return (
        canonical.join(stored, spec.key, "left")
        .withColumn("suppressed", F.coalesce(F.col("_stored") == F.col("checksum"), F.lit(False)))
        .drop("_stored")
    )


def version_guard(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """Add ``outdated``: strictly older than the stored version (equal passes)."""
    stored = versions.select(*AGGREGATE, F.col("latest_processed_version").alias("_latest"))
    older = F.coalesce(F.col("aggregate_version") < F.col("_latest"), F.lit(False))
    return salted_lookup(incoming, stored, AGGREGATE, ["id"]).withColumn("outdated", older).drop("_latest")


def projected_columns(spec: EntitySpec, as_of) -> dict[str, Column]:
    """Projection row of a canonical row that meets no stored row."""
    now = instant(as_of)
    row: dict[str, Column] = {
        "id": surrogate_id(spec.kind, F.col(spec.key)),
        "deleted_at": F.lit(None).cast("timestamp"),
        "created_at": now,
        "synced_at": now,
    }
    row.update(spec.projected(now))
    return {c: row.get(c, F.col(c)) for c in columns(spec.ddl)}


def beside(current: DataFrame, canonical: DataFrame, spec: EntitySpec, as_of, *extra: str) -> DataFrame:
    """Stored and new rows side by side: the key, ``old_*``, ``src_*`` and ``extra``
    canonical columns. One pass and one shuffle of each side."""
    key = spec.natural_key
    fresh = canonical.select(
        *[c.alias(key if n == key else f"src_{n}") for n, c in projected_columns(spec, as_of).items()],
        *[F.col(c).alias(f"_{c}") for c in extra],
    )
    stored = current.selectExpr(
        *[key if c == key else f"{c} AS old_{c}" for c in columns(spec.ddl)])
    return fresh.join(stored, key, "full_outer")


def chosen(spec: EntitySpec, take: str, deleted_at: str) -> list[str]:
    """Projection columns out of ``beside`` rows: new where ``take`` holds, else stored."""
    def column(name: str) -> str:
        if name == spec.natural_key:
            return name
        if name == "deleted_at":
            return f"{deleted_at} AS deleted_at"
        if name in spec.insert_only:
            return f"coalesce(old_{name}, src_{name}) AS {name}"
        return f"if({take}, src_{name}, old_{name}) AS {name}"

    return [column(c) for c in columns(spec.ddl)]


def upsert_rows(current: DataFrame, canonical: DataFrame, spec: EntitySpec, as_of) -> DataFrame:
    """Insert or update by natural key. Surrogate id, creation time and type survive
    an update; ``deleted_at`` becomes NULL."""
    rows = beside(current, canonical, spec, as_of)
    given = "src_id IS NOT NULL"
    return rows.selectExpr(*chosen(spec, given, f"if({given}, NULL, old_deleted_at)"))


def tombstone(current: DataFrame, deletes: DataFrame, spec: EntitySpec) -> DataFrame:
    """Soft delete: ``deletes`` has the natural key and ``source_updated_at``.

    Nothing else of the row changes, and a key without a row is a no-op.
    """
    key = spec.natural_key
    last = deletes.groupBy(key).agg(F.max("source_updated_at").alias("_gone_at"))
    return current.join(last, key, "left").select(
        *[
            (F.coalesce("_gone_at", "deleted_at").alias(c) if c == "deleted_at" else F.col(c))
            for c in columns(spec.ddl)
        ]
    )


def link_rows(
    posts: DataFrame, taxonomies: DataFrame, ids: str = "category_ids", key: str = "source_term_id"
) -> DataFrame:
    """Bridge rows of ``posts`` (id and a list of source ids), known targets only.

    Deletion of a target is not looked at here; reads filter it out.
    """
    wanted = posts.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(ids)).alias(key))
    known = taxonomies.select(key, F.col("id").alias("taxonomy_id"))
    # Unique right side: a hot category is split by AQE's skew join when it is not broadcast.
    return wanted.join(known, key).select("entity_id", "taxonomy_id")


def rewrite_bridge(bridge: DataFrame, posts: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """Replace the links of the written posts as a set."""
    touched = posts.select(F.col("id").alias("entity_id"))
    return replaced(bridge, link_rows(posts, taxonomies), "entity_id", touched)


def ledger_entries(events: DataFrame, as_of) -> DataFrame:
    return events.select(
        F.col("id").alias("event_id"), "checksum", instant(as_of).alias("processed_at")
    )


def append_ledger(ledger: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Ledger with the events' ids added; known ids keep their first entry."""
    entries = ledger_entries(events, as_of).dropDuplicates(["event_id"])
    return ledger.unionByName(entries.join(ledger.select("event_id"), "event_id", "left_anti"))


def advance_versions(versions: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Highest version per aggregate; its time moves only when the incoming one is not older."""
    seen = events.groupBy(*AGGREGATE).agg(F.max("aggregate_version").alias("_seen"))
    stored = F.col("latest_processed_version")
    moves = stored.isNull() | (F.col("_seen") >= stored)
    touched = (
        seen.join(versions.join(seen.select(*AGGREGATE), AGGREGATE, "left_semi"), AGGREGATE, "left")
        .select(
            *AGGREGATE,
            F.greatest(stored, "_seen").alias("latest_processed_version"),
            F.when(moves, instant(as_of)).otherwise(F.col("latest_processed_at")).alias("latest_processed_at"),
        )
    )
    rest = versions.join(seen.select(*AGGREGATE), AGGREGATE, "left_anti")
    return rest.select(*touched.columns).unionByName(touched)
