"""Structured Streaming form of the feed.

The apply path has no watermark: an event is accepted if it is newer by version,
however late it comes. Redelivery is harmless twice over: the ledger and version
guards make a batch idempotent, and the store knows the last batch it committed
for a feed, so a batch re-run after a crash is skipped.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from feedproj.operators.failures import eligible, route_failures
from feedproj.operators.guards import AGGREGATE
from feedproj.schema import ATTEMPTS, DEAD_LETTERS, columns
from feedproj.session import checkpointed
from feedproj.sources.state import SourceState
from feedproj.sources.store import ProjectionStore, put, read_or_empty


def run_projection_stream(
    events: DataFrame,
    store: ProjectionStore,
    source: Callable[[], SourceState],
    as_of: Callable[[int], object],
    checkpoint: str,
    feed: str = "feed",
    every: str | None = None,
    on_outcomes: Callable[[DataFrame, int], None] | None = None,
    **options,
) -> StreamingQuery:
    """Continuous apply of an event stream.

    ``source`` gives one consistent snapshot per batch; ``as_of`` the clock of a
    batch id. A feed's committed batches are known by the query's id, so a stream on a new
    checkpoint applies all it reads (the ledger stops copies). Without ``every`` all available input is applied and the query ends.
    Bound a batch with ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` on the reader.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # A new checkpoint is a new query whose batches start at 0: its ids are not the old one's.
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        outcomes = store.apply(batch, source(), as_of(batch_id), f"{feed}@{query}" if query else feed, batch_id, **options)
        if outcomes is not None and on_outcomes is not None:
            on_outcomes(outcomes, batch_id)

    writer = events.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def failure_sink(path: str, events: Callable[[], DataFrame], as_of, feed: str = "feed"):
    """An ``on_outcomes`` that keeps the attempts table and the dead letters under ``path``.

    Both are tables of a batch's rows by feed and batch, as the store's are. A batch writes
    one row for each event that failed or came through, so its cost follows the batch, and a
    batch run again replaces its own rows. A stream and its retries share ``path`` under
    different ``feed`` names and need not know of each other.
    """

    def keep(outcomes: DataFrame, batch_id: int) -> None:
        spark = outcomes.sparkSession
        before = _attempt_rows(spark, path).where((F.col("feed") != feed) | (F.col("batch") != batch_id))
        step = (before.agg(F.max("step")).first()[0] or 0) + 1
        old = _waiting(before)
        seen = outcomes.select(F.col("id").alias("event_id")).distinct()
        mine = old.join(seen, "event_id", "left_semi")
        waiting, dead = route_failures(outcomes, events(), mine, as_of(batch_id))
        waiting, dead = checkpointed(waiting), checkpointed(dead)
        gone = mine.join(waiting.select("event_id"), "event_id", "left_anti").withColumn("done", F.lit(True))
        put(dead.select(*columns(DEAD_LETTERS)), f"{path}/dead_letters", feed, batch_id)
        rows = waiting.withColumn("done", F.lit(False)).unionByName(gone.select(*waiting.columns, "done"))
        put(rows.withColumn("step", F.lit(step).cast("bigint")), f"{path}/attempts", feed, batch_id)

    return keep


def _attempt_rows(spark: SparkSession, path: str) -> DataFrame:
    ddl = f"{ATTEMPTS}, done boolean, step bigint, feed string, batch bigint"
    return read_or_empty(spark, f"{path}/attempts", ddl).where("event_id IS NOT NULL")


def _waiting(rows: DataFrame) -> DataFrame:
    """The newest row of each event that is still waiting; of two of one step that with more attempts."""
    rest = [c for c in (*columns(ATTEMPTS), "done") if c != "event_id"]
    newest = F.max_by(F.struct(*rest), F.struct("step", "attempts", "available_at")).alias("_row")
    return rows.groupBy("event_id").agg(newest).where("NOT _row.done").select("event_id", *[f"_row.{c}" for c in rest if c != "done"])


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The events that wait for a retry, each once."""
    return _waiting(_attempt_rows(spark, path))


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/dead_letters", DEAD_LETTERS).where("event_id IS NOT NULL")


def retry_due(store: ProjectionStore, path: str, events: DataFrame, source: SourceState, as_of,
              partition: str = "content", batch: int | None = None) -> DataFrame | None:
    """Apply the failed events whose retry is due; returns their outcomes for the sink."""
    due = eligible(read_attempts(store.spark, path), as_of, partition)
    again = events.join(due.select(F.col("event_id").alias("id")), "id", "left_semi")
    return store.apply(again, source, as_of, feed="retry", batch=batch)


def dedup_stream(events: DataFrame, time: str = "created_at", within: str = "1 hour") -> DataFrame:
    """Memory-bounded first filter for copies that arrive close together.

    The ledger stays the authority: copies further apart pass and are caught there.
    """
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(["id"])


class LatestVersion(StatefulProcessor):
    """Keeps the latest version of an aggregate and lets only newer events through."""

    def __init__(self, keep_millis: int | None = None):
        self.keep_millis = keep_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._latest = handle.getValueState("latest", "version bigint", self.keep_millis)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._latest.update((int(initialState["latest_processed_version"].max()),))

    def handleInputRows(self, key, rows, timerValues):
        stored = self._latest.get()
        before = stored[0] if stored is not None else -1
        passed: set[int] = set()
        for batch in rows:
            # Only what the trigger started with decides, however its rows are cut into batches.
            version = batch["aggregate_version"]
            newer = batch[(version > before) & ~version.duplicated() & ~version.isin(passed)]
            if len(newer):
                passed.update(int(v) for v in newer["aggregate_version"])
                yield newer
        if passed:
            self._latest.update((max(passed),))

    def close(self) -> None:
        pass


def stale_filter_stream(
    events: DataFrame, versions: DataFrame | None = None, keep_days: int | None = None
) -> DataFrame:
    """Streaming stale filter with one number of state per aggregate.

    An event passes if its version is above the latest of the triggers before and is the
    first of its version, so events of one trigger pass in any order. Arrow batches of an
    aggregate stream through; what is held is one number per version that passes. Needs
    the RocksDB state store provider.

    ``versions`` (the version table) is the state a new checkpoint starts from, so it drops at
    once what was applied before it. ``keep_days`` forgets an aggregate that was not heard of
    for so long; its late events then pass and meet the version table in the apply step.
    """
    grouped = events.groupBy(*AGGREGATE)
    first = None if versions is None else versions.select(*AGGREGATE, "latest_processed_version").groupBy(*AGGREGATE)
    millis = None if keep_days is None else keep_days * 86_400_000
    return grouped.transformWithStateInPandas(
        statefulProcessor=LatestVersion(millis), outputStructType=events.schema,
        outputMode="Append", timeMode="None" if millis is None else "ProcessingTime", initialState=first,
    )


class ProgressTable(StreamingQueryListener):
    """One row per finished batch, appended to a table as it is reported."""

    def __init__(self, spark, path: str, name: str = "projection"):
        self.spark, self.path, self.name = spark, path, name
        self.ended = threading.Event()  # set after a query's last row is written

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (self.name, str(p.runId), int(p.batchId), p.timestamp, int(p.numInputRows), int(p.batchDuration))
        self.spark.createDataFrame(
            [row], "name string, run_id string, batch_id bigint, at string, rows bigint, millis bigint"
        ).withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def progress_rows(spark, path: str) -> DataFrame:
    """Every finished batch that a ``ProgressTable`` has written, each once."""
    return spark.read.parquet(path).dropDuplicates(["name", "run_id", "batch_id"])
