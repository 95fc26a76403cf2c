"""Projection tables as Spark writes them: changed rows by batch, the newest row of a key counts.

Under one root every table (an entity kind, ``bridge``, ``versions``, ``ledger``,
``outcomes``) is a parquet table partitioned by ``feed`` and ``batch``. A batch writes the
rows it changes by dynamic partition overwrite, so running it again replaces its own rows
and no others, and the cost of a batch follows the batch. Last comes its row in
``commits``: readers take, of each feed, the batches up to its last committed one, so they
see all tables of a batch or none, and what a dead writer left is overwritten by its rerun.

Which row of a key is newest does not depend on who writes first: the higher aggregate
version wins, then the later commit. Two writers need no lock; a forced replay starts a
new ``generation``, whose rows come before all older ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedproj.functions.times import instant
from feedproj.operators.canonical import CONTENT, EntitySpec
from feedproj.operators.guards import AGGREGATE
from feedproj.plans.apply import BatchChanges, ProjectionState, batch_changes
from feedproj.schema import BRIDGE, LEDGER, VERSIONS, columns
from feedproj.session import Staging
from feedproj.sources.state import SourceState

#: Feed whose batches hold whole tables, made by ``compact``.
SNAPSHOT = "_snapshot"
ORDER = ("generation", "version", "seq")
LINKS = "entity_id string, taxonomy_ids array<string>"
OUTCOMES = (
    "id string, event_type string, aggregate_type string, aggregate_id string, aggregate_version bigint, "
    "source_updated_at timestamp, outcome string, recorded boolean, violations array<string>, deliveries bigint, "
    "checksum string"
)
COMMITS = "seq bigint, generation bigint, covers map<string,bigint>, feed string, batch bigint"


def put(rows: DataFrame, path: str, feed: str, batch: int) -> None:
    """Write the rows of one batch, in place of those it wrote before.

    A row of NULLs comes along: without any row the batch's partition would stay as it was.
    """
    spark = rows.sparkSession
    nothing = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    (
        rows.unionByName(nothing)
        .withColumn("feed", F.lit(feed)).withColumn("batch", F.lit(batch).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed", "batch").parquet(path)
    )


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A parquet table that may not have been written yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


@dataclass(frozen=True)
class Committed:
    """What readers may see: each feed's last batch, and what the last snapshot covers."""

    last: dict[str, int]
    covers: dict[str, int]
    seq: int
    generation: int

    def visible(self) -> Column:
        """Condition on the partition columns, so only visible partitions are listed and read."""
        shown = F.lit(False)
        for feed, batch in self.last.items():
            low = batch if feed == SNAPSHOT else self.covers.get(feed, -1) + 1
            if low <= batch:
                shown = shown | ((F.col("feed") == feed) & F.col("batch").between(low, batch))
        return shown

    def only_snapshot(self) -> bool:
        return SNAPSHOT in self.last and all(
            f == SNAPSHOT or self.covers.get(f, -1) >= b for f, b in self.last.items())


class ProjectionStore:
    def __init__(self, spark: SparkSession, root: str, specs: Sequence[EntitySpec] = CONTENT):
        self.spark, self.root, self.specs = spark, root.rstrip("/"), tuple(specs)
        self.tables = {s.kind: (s.ddl, [s.natural_key]) for s in self.specs}
        self.tables["bridge"] = (LINKS, ["entity_id"])
        self.tables["versions"] = (VERSIONS, AGGREGATE)

    # --- reads ---

    def committed(self) -> Committed:
        """One row for each feed comes to the driver."""
        rows = read_or_empty(self.spark, f"{self.root}/commits", COMMITS).where("seq IS NOT NULL").groupBy("feed").agg(
            F.max("batch").alias("batch"), F.max("seq").alias("seq"), F.max("generation").alias("generation"),
            F.max_by("covers", "batch").alias("covers"),
        ).collect()
        covers = next((r["covers"] for r in rows if r["feed"] == SNAPSHOT), None)
        return Committed(
            {r["feed"]: r["batch"] for r in rows}, covers or {},
            max((r["seq"] for r in rows), default=0), max((r["generation"] for r in rows), default=0),
        )

    def _rows(self, name: str, ddl: str, at: Committed, key: str) -> DataFrame:
        read = read_or_empty(self.spark, f"{self.root}/{name}", f"{ddl}, feed string, batch bigint")
        return read.where(at.visible()).where(F.col(key).isNotNull())

    def _newest(self, name: str, at: Committed, ordered: bool = False) -> DataFrame:
        """The newest row of each key. Straight after ``compact`` every key has one row and nothing is grouped."""
        ddl, keys = self.tables[name]
        order = ", ".join(f"{c} bigint" for c in ORDER)
        rows = self._rows(name, f"{ddl}, {order}", at, keys[0])
        shown = [*columns(ddl), *(ORDER if ordered else ())]
        if at.only_snapshot():
            return rows.select(*shown)
        # The order is total: a commit has one row for a key. So every column is of the same row,
        # and with nothing above the grouping Spark moves a semi join on the keys below it.
        order_of = F.struct(*ORDER, "feed", "batch")
        # A tombstone that met no row tells the deletion only; what it deletes another writer may add.
        content = F.when(F.col("id").isNotNull(), order_of) if "id" in shown else order_of
        newest = rows.groupBy(*keys).agg(*[
            F.max_by(c, order_of if c in ("deleted_at", *ORDER) else content).alias(c) for c in shown if c not in keys])
        return newest.select(*shown)

    def _ledger(self, at: Committed) -> DataFrame:
        """One entry for each event: two writers may both have applied it, and a replay applies it again."""
        rows = self._rows("ledger", LEDGER, at, "event_id")
        if at.only_snapshot():
            return rows.select(*columns(LEDGER))
        first = F.struct("processed_at", "checksum")
        return rows.groupBy("event_id").agg(
            F.min_by("checksum", first).alias("checksum"), F.min("processed_at").alias("processed_at"))

    def state(self, at: Committed | None = None, bare: bool = False) -> ProjectionState:
        """The tables as committed. ``bare`` leaves in the rows without an id that tombstones
        wrote which met no row: with nothing above the grouping Spark pushes a semi join with a
        batch's keys below it, so only their rows are grouped."""
        at = at or self.committed()
        entities = [(s, self._newest(s.kind, at)) for s in self.specs]
        bridge = self._newest("bridge", at).select("entity_id", F.explode("taxonomy_ids").alias("taxonomy_id"))
        return ProjectionState(
            {s.kind: rows if bare else rows.where("id IS NOT NULL") for s, rows in entities}, bridge.select(*columns(BRIDGE)),
            self._ledger(at), self._newest("versions", at),
        )

    def outcomes(self, feed: str, batch: int) -> DataFrame:
        """What became of every event of one batch."""
        rows = self.spark.read.schema(f"{OUTCOMES}, feed string, batch bigint").parquet(f"{self.root}/outcomes")
        return rows.where((F.col("feed") == feed) & (F.col("batch") == batch) & F.col("outcome").isNotNull()).drop("feed", "batch")

    # --- writes ---

    def write_projection(self, changes: BatchChanges, as_of, feed: str, batch: int, forced: bool = False,
                         base: Committed | None = None) -> None:
        """Commit one batch: projections, bridge, ledger and versions, or nothing.

        The tables are written side by side, the commit when all are there.
        """
        base = base or self.committed()
        seq, generation = base.seq + 1, base.generation + bool(forced)
        order = [F.lit(generation).cast("bigint").alias("generation"), F.col("_version").cast("bigint").alias("version"),
                 F.lit(seq).cast("bigint").alias("seq")]
        tables = {"outcomes": changes.outcomes.select(*columns(OUTCOMES))}
        for spec in changes.specs:
            tables[spec.kind] = changes.written[spec.kind].select(*columns(spec.ddl), *order)
        if changes.specs:
            links = changes.linked.groupBy("entity_id").agg(F.collect_set("taxonomy_id").alias("taxonomy_ids"))
            entities = changes.relinked.groupBy("entity_id").agg(F.max("_version").alias("_version"))
            tables["bridge"] = entities.join(links, "entity_id", "left").select(
                "entity_id", F.coalesce("taxonomy_ids", F.array().cast("array<string>")).alias("taxonomy_ids"), *order)
            tables["versions"] = changes.versions.select(
                *AGGREGATE, F.col("aggregate_version").alias("latest_processed_version"),
                instant(as_of).alias("latest_processed_at"), F.col("aggregate_version").alias("_version"),
            ).select(*columns(VERSIONS), *order)
            tables["ledger"] = changes.ledger.select(*columns(LEDGER))
        with ThreadPoolExecutor(len(tables)) as side_by_side:
            written = [side_by_side.submit(put, rows, f"{self.root}/{name}", feed, batch) for name, rows in tables.items()]
            for one in written:
                one.result()
        self._commit(feed, batch, seq, generation)

    def _commit(self, feed: str, batch: int, seq: int, generation: int, covers: dict[str, int] | None = None) -> None:
        row = self.spark.createDataFrame([(seq, generation, covers)], ", ".join(COMMITS.split(", ")[:3]))
        put(row, f"{self.root}/commits", feed, batch)

    def compact(self) -> None:
        """Whole tables as one batch of their own, so that later reads need not group what came before.

        Batches committed meanwhile are not covered and stay beside it.
        """
        at = self.committed()
        if not at.last or at.only_snapshot():
            return
        batch = at.last.get(SNAPSHOT, -1) + 1
        for name in self.tables:
            put(self._newest(name, at, ordered=True).hint("rebalance"), f"{self.root}/{name}", SNAPSHOT, batch)
        put(self._ledger(at).hint("rebalance"), f"{self.root}/ledger", SNAPSHOT, batch)
        covers = {f: b for f, b in at.last.items() if f != SNAPSHOT}
        self._commit(SNAPSHOT, batch, at.seq + 1, at.generation, covers)

    def apply(self, events: DataFrame, source: SourceState, as_of, feed: str = "feed",
              batch: int | None = None, **options) -> DataFrame | None:
        """Apply and commit a batch; returns its outcomes.

        A ``batch`` that is the feed's last committed one is not applied again: its
        stored outcomes come back. An older one gives None. Without a number the batch is
        the feed's next.
        """
        base = self.committed()
        last = base.last.get(feed)
        if batch is not None and last is not None and last >= batch:
            return self.outcomes(feed, batch) if last == batch else None
        batch = (-1 if last is None else last) + 1 if batch is None else batch
        steps = Staging(self.spark)
        try:
            # Rows without an id count as absent there.
            changes = batch_changes(events, self.state(base, bare=True), source, as_of, specs=self.specs, stage=steps, **options)
            self.write_projection(changes, as_of, feed, batch, forced=bool(options.get("force")), base=base)
        finally:
            steps.clear()
        return self.outcomes(feed, batch)
