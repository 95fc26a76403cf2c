"""One batch of events against the projection state, as a set.

The closed form gives what one-by-one processing in version order gives, with the
source held still: of an aggregate's fresh events only the lowest and highest
upsert and the highest tombstone matter. Categories are applied before posts, so
a post is linked to every category the batch leaves present.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedproj.functions.ids import surrogate_id
from feedproj.functions.times import instant
from feedproj.operators.canonical import CONTENT, EntitySpec, canonicalise, extract, violations
from feedproj.operators.guards import AGGREGATE, action, is_fresh, one_copy, reduce_aggregates, registered
from feedproj.operators.kinds import CONTENT_KINDS, Kinds
from feedproj.operators.projection import (
    advance_versions,
    link_rows,
    projected_columns,
    replaced,
)
from feedproj.operators.skew import HOT_ROWS, hot_keys, repeated, spread
from feedproj.schema import BRIDGE, FAILURES, LEDGER, VERSIONS, columns
from feedproj.sources.state import SourceState, load_source_state


@dataclass(frozen=True)
class ProjectionState:
    """The tables that are committed together."""

    entities: dict[str, DataFrame]
    bridge: DataFrame
    ledger: DataFrame
    versions: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, specs: Sequence[EntitySpec] = CONTENT) -> ProjectionState:
        def nothing(ddl: str) -> DataFrame:
            return spark.createDataFrame([], ddl)

        return cls(
            {s.kind: nothing(s.ddl) for s in specs}, nothing(BRIDGE), nothing(LEDGER), nothing(VERSIONS)
        )


@dataclass(frozen=True)
class BatchChanges:
    """What a batch changes, before it is merged into the tables."""

    rows: dict[str, DataFrame]
    touched: dict[str, DataFrame]
    # Of ``rows`` those that an event changed or confirmed, with its version as ``_version``, and
    # a row of key and ``deleted_at`` alone where a tombstone met no row.
    written: dict[str, DataFrame]
    linked: DataFrame
    relinked: DataFrame
    ledger: DataFrame
    versions: DataFrame
    outcomes: DataFrame
    specs: Sequence[EntitySpec] = field(default=CONTENT)


def _keep(df: DataFrame) -> DataFrame:
    return df


def batch_changes(
    events: DataFrame,
    state: ProjectionState,
    source: SourceState,
    as_of,
    specs: Sequence[EntitySpec] = CONTENT,
    resurrect: bool = False,
    late_link: bool = False,
    force: bool = False,
    stage: Callable[[DataFrame], DataFrame] = _keep,
    hot_rows: int = HOT_ROWS,
) -> BatchChanges:
    """Resolve a batch to changed rows and one outcome per event id.

    ``stage`` materialises the intermediates that several outputs share
    (``session.checkpointed`` when writing); by default the plan stays lazy.
    ``force`` replays stored events past the ledger and version guards. ``specs`` are the
    kinds resolved here; together with the content kinds they decide which types are known.
    """
    now = instant(as_of)
    kinds = CONTENT_KINDS.with_(specs)
    guarded = stage(_guarded_events(events, state, force, hot_rows, stage, kinds))
    hot = hot_keys(guarded, AGGREGATE, hot_rows)
    live = guarded.where(F.col("_fresh"))
    if stage is not _keep:
        # Only the kinds that occur are resolved; a batch of stale copies resolves nothing.
        occurring = {r[0] for r in live.select("aggregate_type").distinct().collect()}
        specs = [s for s in specs if s.kind in occurring]
    latest = F.max("latest").alias("latest")
    reduced = reduce_aggregates(live, kinds).join(
        live.where("latest IS NOT NULL").groupBy(*AGGREGATE).agg(latest), AGGREGATE, "left"
    ) if force else reduce_aggregates(live, kinds).withColumn("latest", F.lit(None).cast("bigint"))

    rows, touched, written, verdicts = {}, {}, {}, []
    resolved = {}
    for spec in specs:
        part = stage(_resolve(reduced, state.entities[spec.kind], source, spec, now, resurrect))
        resolved[spec.kind] = part
        rows[spec.kind] = part.where("_exists").selectExpr(
            *[f"new_{c} AS {c}" for c in columns(spec.ddl)]
        )
        written[spec.kind] = part.where("_key IS NOT NULL AND applied_version IS NOT NULL").selectExpr(
            *[_bare(c, spec) for c in columns(spec.ddl)], "applied_version AS _version"
        )
        touched[spec.kind] = part.where("_key IS NOT NULL").selectExpr(f"_key AS {spec.natural_key}")
        verdicts.append(part.select(*AGGREGATE, *_VERDICT))
    spark = events.sparkSession
    verdict = reduce(DataFrame.unionByName, verdicts) if verdicts else spark.createDataFrame([], _VERDICT_DDL)

    linked, relinked = _links(resolved, rows, touched, state, source, specs, late_link)

    joined = spread(guarded, hot, AGGREGATE, ["id"]).join(
        repeated(verdict, hot, AGGREGATE), [*AGGREGATE, "_salt"], "left"
    ).drop("_salt")
    outcomes = joined.selectExpr(
        "id", "event_type", *AGGREGATE, "aggregate_version", "source_updated_at",
        f"{_OUTCOME} AS outcome",
        f"{_RECORDED} AS recorded",
        "if(outcome = 'rejected', violations, NULL) AS violations",
        "deliveries",
        "if(_action = 'upsert', new_sum, checksum) AS checksum",
    )
    done = outcomes.where("recorded")
    return BatchChanges(
        rows=rows,
        touched=touched,
        written=written,
        linked=linked,
        relinked=relinked,
        ledger=done.select(F.col("id").alias("event_id"), "checksum", now.alias("processed_at")),
        versions=verdict.where("applied_version IS NOT NULL").select(
            *AGGREGATE, F.col("applied_version").alias("aggregate_version")
        ),
        outcomes=outcomes,
        specs=specs,
    )


def merge_changes(state: ProjectionState, changes: BatchChanges, as_of) -> ProjectionState:
    """State after the batch."""
    entities = dict(state.entities)
    for spec in changes.specs:
        key = spec.natural_key
        entities[spec.kind] = replaced(
            state.entities[spec.kind], changes.rows[spec.kind], key, changes.touched[spec.kind]
        )
    return replace(
        state,
        entities=entities,
        bridge=replaced(state.bridge, changes.linked, "entity_id", changes.relinked),
        ledger=state.ledger.unionByName(changes.ledger.join(
            state.ledger.select("event_id"), "event_id", "left_anti")),
        versions=advance_versions(state.versions, changes.versions, as_of),
    )


def apply_batch(
    events: DataFrame, state: ProjectionState, source: SourceState, as_of, **options
) -> tuple[ProjectionState, DataFrame]:
    """(new state, outcomes). Options as for ``batch_changes``."""
    changes = batch_changes(events, state, source, as_of, **options)
    return merge_changes(state, changes, as_of), changes.outcomes


def failures(outcomes: DataFrame) -> DataFrame:
    """The outcomes that go to retry or dead letter."""
    return outcomes.where(F.col("outcome").isin(*FAILURES))


# --- steps ------------------------------------------------------------------

_VERDICT = [
    "min_ok", "max_ok", "max_d", "source_state", "violations", "new_sum", "wrote", "down_holds",
    "applied_version",
]


_VERDICT_DDL = (
    "aggregate_type string, aggregate_id string, min_ok bigint, max_ok bigint, max_d bigint, "
    "source_state string, violations array<string>, new_sum string, wrote boolean, "
    "down_holds boolean, applied_version bigint"
)


def _guarded_events(
    events: DataFrame, state: ProjectionState, force: bool, hot_rows: int, stage, kinds: Kinds
) -> DataFrame:
    """One row per event id with ``latest``, ``_known`` (in the ledger) and ``_fresh``.

    Shuffled by id for copies and ledger together, then by aggregate for versions.
    """
    slim = events.select(
        "id", "event_type", *AGGREGATE, "aggregate_version", "source_updated_at", "checksum"
    )
    # The ledger only grows: it is filtered to this batch's ids, which are broadcast
    # when they are few, rather than shuffled against them.
    known = state.ledger.select(F.col("event_id").alias("id")).join(
        slim.select("id"), "id", "left_semi"
    ).withColumn("_known", F.lit(True))
    # Copies of an id are reduced inside each task before they move; the ledger
    # then meets them where they are.
    once = stage(one_copy(slim, "id", F.count(F.lit(1)).alias("deliveries")).join(known, "id", "left"))
    hot = hot_keys(once, AGGREGATE, hot_rows)
    keys = once.select(*AGGREGATE).distinct()
    latest = state.versions.select(*AGGREGATE, F.col("latest_processed_version").alias("latest")).join(
        keys, AGGREGATE, "left_semi"
    )
    seen = (
        spread(once, hot, AGGREGATE, ["id"])
        .join(repeated(latest, hot, AGGREGATE), [*AGGREGATE, "_salt"], "left")
        .drop("_salt")
    )
    fresh = F.lit(True) if force else is_fresh() & F.col("_known").isNull()
    return (
        seen.withColumn("_registered", registered(F.col("event_type"), kinds))
        .withColumn("_action", action(F.col("event_type"), kinds))
        .withColumn("_stale", F.lit(False) if force else ~is_fresh())
        .withColumn("_fresh", F.col("_registered") & fresh)
    )


def _resolve(reduced, current, source: SourceState, spec: EntitySpec, now, resurrect: bool) -> DataFrame:
    """Per touched aggregate: its row afterwards (``new_*``) and what decided it."""
    mine = reduced.where(F.col("aggregate_type") == spec.kind).withColumn(
        "_key", F.col("aggregate_id").try_cast("bigint")
    )
    loaded = load_source_state(source, spec, mine.where("max_u IS NOT NULL").select("_key"))
    checked = loaded.withColumn("violations", violations(spec))
    typed = checked.select(
        "_key", "violations", *[c.alias(n) for n, c in spec.extract(now).items()]
    )
    canonical = canonicalise(typed, spec)
    shown = canonical.select(
        "_key", "violations",
        *[c.alias(f"src_{n}") for n, c in projected_columns(spec, now).items()],
        *[F.col(c).alias(f"link_{c}") for c, _ in spec.links],
    )
    stored = current.join(
        mine.selectExpr(f"_key AS {spec.natural_key}"), spec.natural_key, "left_semi"
    ).selectExpr(
        f"{spec.natural_key} AS _key", *[f"{c} AS old_{c}" for c in columns(spec.ddl)]
    )
    decided = (
        mine.join(shown, "_key", "left")
        .join(stored, "_key", "left")
        .withColumn("_resurrect", F.lit(resurrect))
        .selectExpr("*", *_DECISIONS)
    )

    def final(name: str) -> str:
        if name == "deleted_at":
            return "_gone_at AS new_deleted_at"
        if name in spec.insert_only:
            return f"coalesce(old_{name}, src_{name}) AS new_{name}"
        return f"if(wrote, src_{name}, old_{name}) AS new_{name}"

    return decided.selectExpr(
        *AGGREGATE, "_key", "_exists", *_VERDICT,
        *[f"link_{c}" for c, _ in spec.links],
        *[final(c) for c in columns(spec.ddl)],
    )


# What becomes of one aggregate, from its reduced events (min_u, max_u, max_d, t_d),
# the source row (src_*, violations) and the stored row (old_*). Later lines use
# earlier ones.
_DECISIONS = [
    "coalesce(size(violations) = 0, false) AS _ok",
    """CASE WHEN max_u IS NULL THEN 'unread' WHEN violations IS NULL THEN 'orphan'
            WHEN NOT _ok THEN 'rejected' ELSE 'ok' END AS source_state""",
    "if(_ok, max_u, NULL) AS max_ok",
    "if(_ok, min_u, NULL) AS min_ok",
    "old_id IS NOT NULL AS _has_old",
    "coalesce(old_checksum = src_checksum, false) AS _same",
    "coalesce(max_ok > coalesce(max_d, -1), false) AS _up_last",
    "coalesce(max_d > coalesce(max_ok, -1), false) AS _down_last",
    # A row tombstoned and published again with the same checksum stays deleted,
    # unless the caller asks for the restore lifecycle.
    """NOT _resurrect AND _up_last AND max_d IS NOT NULL
       AND (min_ok < max_d OR _same) AS _stays_down""",
    """_resurrect AND _up_last AND _same
       AND (old_deleted_at IS NOT NULL OR max_d IS NOT NULL) AS _restores""",
    "max_ok IS NOT NULL AND (NOT _same OR _restores) AS wrote",
    "_has_old OR max_ok IS NOT NULL AS _exists",
    """CASE WHEN coalesce(greatest(max_u, max_d) < latest, false) THEN old_deleted_at
            WHEN _down_last OR _stays_down THEN t_d
            WHEN _up_last AND (_resurrect OR NOT _same OR max_d IS NOT NULL) THEN NULL
            ELSE old_deleted_at END AS _gone_at""",
    "_down_last OR _stays_down AS down_holds",
    "greatest(max_ok, max_d) AS applied_version",
    "src_checksum AS new_sum",
]


def _bare(name: str, spec: EntitySpec) -> str:
    if name == spec.natural_key:
        return f"_key AS {name}"
    return f"new_{name} AS {name}" if name == "deleted_at" else f"if(_exists, new_{name}, NULL) AS {name}"


def _after(state: ProjectionState, kind: str, key: str, rows, touched) -> DataFrame:
    """One entity table as the batch leaves it."""
    current = state.entities[kind]
    return replaced(current, rows[kind], key, touched[kind]) if kind in rows else current


def _links(resolved, rows, touched, state, source, specs, late_link: bool):
    """(new bridge rows, entity ids whose old rows they replace, with the version that did)."""
    links = state.bridge.limit(0)
    gone = state.bridge.limit(0).select("entity_id", F.lit(0).cast("bigint").alias("_version"))
    known = CONTENT_KINDS.with_(specs)
    for spec in specs:
        for column, kind in spec.links:
            if kind not in known.aggregate_types or kind not in state.entities:
                continue  # no rows of that kind here to link to
            written = resolved[spec.kind].where("wrote").selectExpr("new_id AS id", f"link_{column} AS ids")
            key = known.spec(kind).natural_key
            links = links.unionByName(link_rows(written, _after(state, kind, key, rows, touched), "ids", key))
        if spec.links:
            gone = gone.unionByName(
                resolved[spec.kind].where("wrote").selectExpr("new_id AS entity_id", "applied_version AS _version"))
    if not (late_link and "category" in rows):
        return links, gone
    # Posts written before their category existed are linked from the source now.
    arrived = rows["category"].join(
        state.entities["category"].select("source_term_id"), "source_term_id", "left_anti"
    ).selectExpr("source_term_id AS term_id", "id AS taxonomy_id")
    posts = _after(state, "post", "source_post_id", rows, touched).selectExpr(
        "source_post_id AS post_id", "id AS entity_id")
    late = (
        source.post_terms.selectExpr("post_id", "cast(term_id AS bigint) AS term_id")
        .distinct()
        .join(arrived, "term_id")
        .join(posts, "post_id")
        .select("entity_id", "taxonomy_id")
        .join(gone, "entity_id", "left_anti")
    )
    # Their older links stay.
    kept = state.bridge.join(late.select("entity_id"), "entity_id", "left_semi")
    late = late.unionByName(kept.join(gone, "entity_id", "left_anti")).distinct()
    # A link that arrives late leaves the post's version as it is.
    known = state.versions.where("aggregate_type = 'post'").select(
        surrogate_id("post", F.col("aggregate_id")).alias("entity_id"), F.col("latest_processed_version").alias("_version"))
    joined = late.select("entity_id").distinct().join(known, "entity_id", "left").select(
        "entity_id", F.coalesce("_version", F.lit(0)).cast("bigint").alias("_version"))
    return links.unionByName(late), gone.unionByName(joined)


_OUTCOME = """
CASE WHEN NOT _registered THEN 'unregistered'
     WHEN _stale THEN 'stale'
     WHEN NOT _fresh THEN 'duplicate'
     WHEN source_state IS NULL THEN 'unhandled'
     WHEN _action = 'upsert' AND source_state <> 'ok'
     THEN if(coalesce(max_d > aggregate_version, false), 'superseded', source_state)
     WHEN _action = 'upsert' AND aggregate_version = max_ok
     THEN if(wrote, 'applied', 'suppressed_checksum')
     WHEN _action = 'tombstone' AND aggregate_version = max_d AND down_holds THEN 'applied'
     ELSE 'superseded' END"""
# Recorded: fresh, of an aggregate some spec resolved, and not an upsert without a usable source.
_RECORDED = "_fresh AND source_state IS NOT NULL AND NOT (_action = 'upsert' AND source_state <> 'ok')"
