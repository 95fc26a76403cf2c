"""Every event is recorded, stale, a copy or a failure; nothing depends on sizes or on who writes first."""

import pytest
from pyspark.sql import functions as F

from feedproj.operators import search, skew
from feedproj.sources import store as store_module
from feedproj.sources.store import ProjectionStore
from feedproj.streaming import projection as streaming
from test_store_stream import SPECS, event, events_frame, source_frame, titles


@pytest.mark.parametrize("first", ["stream", "retry"])
@pytest.mark.parametrize("same", [False, True])
def test_two_writers_need_no_order(spark, tmp_path, monkeypatch, first, same):
    """A writer that started before another one committed loses nothing and undoes nothing."""
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    source = source_frame(spark, [(1, "one"), (2, "two")])
    other = 1 if same else 2
    batches = {
        "stream": events_frame(spark, [event(1, "post", 1, 1, "created")]),
        "retry": events_frame(spark, [event(2, "post", other, 2, "deleted" if same else "created")]),
    }
    store.apply(events_frame(spark, [event(9, "post", 2, 1, "created")]), source, "2024-05-01", "stream", 0)
    second = {"stream": "retry", "retry": "stream"}[first]
    changes, between = store_module.batch_changes, []

    def interrupted(*args, **options):
        if not between:
            between.append(True)
            ProjectionStore(spark, store.root, SPECS).apply(batches[first], source, "2024-06-01", first, 1)
        return changes(*args, **options)

    monkeypatch.setattr(store_module, "batch_changes", interrupted)
    store.apply(batches[second], source, "2024-06-01", second, 1)
    state = store.state()
    versions = {r.aggregate_id: r.latest_processed_version for r in state.versions.collect()}
    assert versions == ({"1": 2, "2": 1} if same else {"1": 1, "2": 2})
    assert sorted(r.event_id for r in state.ledger.collect()) == ["e0001", "e0002", "e0009"]
    shown = titles(store)
    # A tombstone that ran beside the creation met no row, and still the row is deleted.
    assert shown == {1: ("one", same), 2: ("two", False)}
    assert store.committed().last == {"stream": 1, "retry": 1}
    store.compact()
    assert titles(store) == shown


def test_a_dead_writer_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    source = source_frame(spark, [(1, "one"), (2, "two")])

    def dies(self, *args, **options):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(ProjectionStore, "_commit", dies)
        with pytest.raises(OSError):
            store.apply(events_frame(spark, [event(2, "post", 2, 1, "created")]), source, "2024-06-01", "retry", 0)
    store.apply(events_frame(spark, [event(1, "post", 1, 1, "created")]), source, "2024-06-01", "stream", 0)
    assert titles(store) == {1: ("one", False)}
    assert {r.event_id for r in store.state().ledger.collect()} == {"e0001"}


def test_events_without_a_verdict_are_failures(spark, tmp_path):
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    feed = events_frame(spark, [event(1, "post", 1, 1, "created"), event(2, "post", 1, 2, "updated")])
    odd = feed.where("id = 'e0001'").selectExpr("*").withColumn("id", F.lit("odd1")).withColumn("aggregate_type", F.lit("gadget"))
    none = feed.where("id = 'e0001'").withColumn("id", F.lit("odd2")).withColumn("aggregate_id", F.lit(None).cast("string"))
    out = store.apply(feed.union(odd).union(none), source_frame(spark, [(1, "one")]), "2024-06-01").collect()
    found = {r.id: (r.outcome, r.recorded) for r in out}
    assert found["odd1"] == found["odd2"] == ("unhandled", False)
    for name, (outcome, recorded) in found.items():
        assert recorded or outcome in ("stale", "duplicate", "rejected", "orphan", "unregistered", "unhandled"), name


def test_stream_and_retries_share_the_attempts_table(spark, tmp_path):
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    path = str(tmp_path / "f")
    feed = events_frame(spark, [event(1, "post", 1, 1, "created"), event(2, "post", 2, 1, "created")])
    nothing = source_frame(spark, [])
    stream = streaming.failure_sink(path, lambda: feed, lambda b: "2024-06-01")
    retry = streaming.failure_sink(path, lambda: feed, lambda b: "2024-06-02", feed="retry")
    attempts = lambda: {r.event_id: r.attempts for r in streaming.read_attempts(spark, path).collect()}
    stream(store.apply(feed.where("id = 'e0001'"), nothing, "2024-06-01", batch=0), 0)
    retry(streaming.retry_due(store, path, feed, nothing, "2024-06-02", batch=0), 0)
    assert attempts() == {"e0001": 2}
    last = store.apply(feed.where("id = 'e0002'"), nothing, "2024-06-02", batch=1)
    stream(last, 1)
    stream(last, 1)
    assert attempts() == {"e0001": 2, "e0002": 1}


def test_a_new_checkpoint_skips_nothing(spark, tmp_path):
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    source = source_frame(spark, [(1, "one"), (2, "two")])
    for number, checkpoint in ((1, "a"), (2, "b")):
        batch = events_frame(spark, [event(number, "post", number, 1, "created")])
        batch.coalesce(1).write.parquet(str(tmp_path / f"in{number}"))
        streaming.run_projection_stream(
            spark.readStream.schema(batch.schema).parquet(str(tmp_path / f"in{number}")), store, lambda: source,
            lambda _: "2024-06-01", str(tmp_path / checkpoint),
        ).awaitTermination()
    assert titles(store) == {1: ("one", False), 2: ("two", False)}


@pytest.mark.parametrize("rows", [3, 10_000])
def test_stale_filter_ignores_arrow_batches(spark, tmp_path, rows):
    before = {k: spark.conf.get(k, None) for k in (
        "spark.sql.streaming.stateStore.providerClass", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        landing, checkpoint, out = (str(tmp_path / x) for x in ("in", "state", "out"))
        # First trigger: versions 11 to 30, newest first. Second: all of 1 to 40, so 1 to 30 are stale.
        for versions in (range(30, 10, -1), range(40, 0, -1)):
            batch = events_frame(spark, [event(5 * len(versions) + v, "post", 1, v, "updated") for v in versions])
            batch.coalesce(1).write.mode("append").parquet(landing)
            stream = streaming.stale_filter_stream(spark.readStream.schema(batch.schema).parquet(landing))
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        got = sorted(r.aggregate_version for r in spark.read.parquet(out).collect())
        assert got == list(range(11, 41))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_search_terms_are_cut_like_documents(spark):
    df = spark.createDataFrame([(1, "covid-19 re-opens"), (2, "19 trains"), (3, "nothing")], "id int, body string")
    assert {r.id for r in search.search(df, F.col("body"), ["covid-19"]).collect()} == {1, 2}
    index = search.inverted_index(df, "id", F.col("body"))
    assert {r.id for r in search.search_index(index, "id", ["COVID-19"], F.lit(3)).collect()} == {1, 2}
    assert search.search(df, F.col("body"), ["--"]).count() == 0


def test_all_hot_keys_are_listed(spark):
    df = spark.range(300).selectExpr("id % 100 as k", "id")
    assert skew.hot_keys(df, ["k"], rows=2).count() == 100
