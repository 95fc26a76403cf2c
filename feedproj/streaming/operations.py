"""Metrics, alerts and retries as streams: windows that feed a second state, and timers."""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedproj.operators.ops import feed_metrics
from feedproj.schema import ATTEMPTS, QUEUE_LAG_TARGET_SECONDS

ALERTS = "queue_name string, bucket timestamp, alert string, max_lag_seconds bigint, n_dead bigint"


def metrics_stream(
    events: DataFrame, ledger: DataFrame, attempts: DataFrame, dead_letters: DataFrame, as_of,
    bucket: str = "1 hour", late: str = "1 day",
) -> DataFrame:
    """The rows of :func:`ops.feed_metrics`, each once, when no event can come into its bucket any more.

    ``events`` is a stream; the other tables are read as they are at each trigger. State is
    one row for each open bucket. Events that come more than ``late`` behind the newest are
    left out of the metrics (never of the feed itself).
    """
    return feed_metrics(events.withWatermark("created_at", late), ledger, attempts, dead_letters, as_of, bucket)


class DeadLetterGrowth(StatefulProcessor):
    """Keeps a partition's last count of dead letters; buckets arrive in order of time."""

    def __init__(self, max_lag: int):
        self.max_lag = max_lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "n_dead bigint")

    def handleInputRows(self, key, rows, timerValues):
        buckets = pd.concat(list(rows)).sort_values("bucket")
        stored = self._last.get()
        before = stored[0] if stored is not None else 0
        found = []
        for row in buckets.itertuples():
            alerts = ["queue_lag"] * (row.max_lag_seconds > self.max_lag) + ["dead_letter_growth"] * (row.n_dead > before)
            found += [(key[0], row.bucket, alert, row.max_lag_seconds, row.n_dead) for alert in alerts]
            before = int(row.n_dead)
        self._last.update((before,))
        yield pd.DataFrame(found, columns=["queue_name", "bucket", "alert", "max_lag_seconds", "n_dead"])

    def close(self) -> None:
        pass


def alerts_stream(metrics: DataFrame, max_lag: int = QUEUE_LAG_TARGET_SECONDS) -> DataFrame:
    """The rows of :func:`ops.alerts` from a stream of metrics: a second state behind the windows.

    Closed buckets come once and in order, so one number for each partition is all that is
    kept. What one trigger closes for a partition is one task's work: its buckets, not its events.
    """
    slim = metrics.select("queue_name", "bucket", "max_lag_seconds", "n_dead")
    return slim.groupBy("queue_name").transformWithStateInPandas(
        statefulProcessor=DeadLetterGrowth(max_lag), outputStructType=ALERTS, outputMode="Append", timeMode="None")


class RetryTimer(StatefulProcessor):
    """Holds an event's newest attempt and lets it go when it is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._row = handle.getValueState("attempt", ATTEMPTS)

    def handleInputRows(self, key, rows, timerValues):
        stored = self._row.get()
        newest = stored
        for batch in rows:
            for row in batch.itertuples(index=False):
                attempt = tuple(None if pd.isna(x) else x for x in row)
                if newest is None or attempt[2] > newest[2]:
                    newest = attempt
        if newest is not stored:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._row.update(newest)
            self._handle.registerTimer(max(1, _millis(newest[3])))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        row = self._row.get()
        self._row.clear()
        if row is not None:
            yield pd.DataFrame([row], columns=[part.split()[0] for part in ATTEMPTS.split(", ")])

    def close(self) -> None:
        pass


def _millis(at) -> int:
    """Milliseconds of a due time; what has none is due at once."""
    if at is None:
        return 1
    at = at.to_pydatetime() if isinstance(at, pd.Timestamp) else at
    return int((at if isinstance(at, datetime) and at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def retry_stream(failures: DataFrame) -> DataFrame:
    """Scheduled attempts, each let go at its ``available_at`` by a processing-time timer.

    ``failures`` is a stream of rows of the attempts table (see ``failures.schedule_retry``).
    A later attempt of an event replaces the one that waits, so what comes out is what
    ``failures.eligible`` finds in the table at that time. State is one row for each waiting
    event. Needs the RocksDB state store provider.
    """
    names = [part.split()[0] for part in ATTEMPTS.split(", ")]
    return failures.select(*names).groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=RetryTimer(), outputStructType=ATTEMPTS, outputMode="Append", timeMode="ProcessingTime")
