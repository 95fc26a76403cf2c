"""The store's commit and the streaming form: crashes, redelivery, order."""

import pytest
from pyspark.sql import functions as F
from test_apply import event, events_frame, source_frame

from feedproj.operators.canonical import CATEGORY, POST
from feedproj.sources.store import ProjectionStore
from feedproj.streaming import projection as streaming

SPECS = (CATEGORY, POST)


def titles(store):
    return {r.source_post_id: (r.title, r.deleted_at is not None) for r in store.state().entities["post"].collect()}


def test_commit_is_all_or_nothing(spark, tmp_path):
    source = source_frame(spark, [(1, "one"), (2, "two")], [(10, "A")], [(1, 10)])
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    store.apply(events_frame(spark, [event(1, "category", 10, 1, "created"), event(2, "post", 1, 1, "created")]),
                source, "2024-06-01", batch=0)
    assert titles(store) == {1: ("one", False)} and store.state().bridge.count() == 1

    # A crash after the data and before the commit leaves readers where they were.
    commit = store._commit
    store._commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    second = events_frame(spark, [event(3, "post", 2, 1, "created"), event(4, "post", 1, 2, "deleted")])
    with pytest.raises(RuntimeError):
        store.apply(second, source, "2024-06-02", batch=1)
    assert titles(store) == {1: ("one", False)} and store.state().ledger.count() == 2

    # The re-run completes; a third delivery of the same batch is skipped.
    store._commit = commit
    assert {r.outcome for r in store.apply(second, source, "2024-06-02", batch=1).collect()} == {"applied"}
    assert titles(store) == {1: ("one", True), 2: ("two", False)} and store.state().ledger.count() == 4
    assert {r.outcome for r in store.apply(second, source, "2024-06-02", batch=1).collect()} == {"applied"}
    assert store.committed().last == {"feed": 1} and store.apply(second, source, "2024-06-02", batch=0) is None
    # Delivered again under another batch id: all stale, nothing moves.
    assert {r.outcome for r in store.apply(second, source, "2024-06-03", batch=2).collect()} == {"stale"}
    assert titles(store) == {1: ("one", True), 2: ("two", False)}
    assert store.state().bridge.count() == 1 and store.state().ledger.count() == 4
    before = sorted(store.state().ledger.collect()), titles(store), sorted(store.state().bridge.collect())
    store.compact()
    assert (sorted(store.state().ledger.collect()), titles(store), sorted(store.state().bridge.collect())) == before
    plan = store.state(bare=True).entities["post"]._jdf.queryExecution().toString()
    assert "Aggregate" not in plan
    third = events_frame(spark, [event(9, "post", 2, 2, "updated")])
    assert [r.outcome for r in store.apply(third, source, "2024-06-04", batch=3).collect()] == ["suppressed_checksum"]
    assert store.state().ledger.count() == 5


def test_a_rerun_leaves_nothing_of_the_first_try(spark, tmp_path):
    """The rerun has no links and no failed try's rows show through."""
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    linked = source_frame(spark, [(1, "one")], [(10, "A")], [(1, 10)])
    bare = source_frame(spark, [(1, "one more")], [(10, "A")], [])
    feed = events_frame(spark, [event(1, "category", 10, 1, "created"), event(2, "post", 1, 1, "created")])
    commit = store._commit
    store._commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.apply(feed, linked, "2024-06-01", batch=0)
    store._commit = commit
    store.apply(feed, bare, "2024-06-02", batch=0)
    assert titles(store) == {1: ("one more", False)} and store.state().bridge.count() == 0


def test_small_batches_do_not_group_the_tables(spark, tmp_path):
    """The semi join with a batch's keys is below the grouping of the stored rows."""
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    source = source_frame(spark, [(k, f"title {k}") for k in range(50)])
    for n in range(2):
        store.apply(events_frame(spark, [event(100 * n + k, "post", k, n + 1, "updated") for k in range(50)]), source, "2024-06-01", batch=n)
    spark.createDataFrame([(3,)], "source_post_id bigint").write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))  # of known size, as a batch's staged keys are
    kept = store.state(bare=True).entities["post"].join(keys, "source_post_id", "left_semi")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    assert [r.source_post_id for r in kept.collect()] == [3]


def test_stream_with_late_and_repeated_events(spark, tmp_path):
    source = source_frame(spark, [(1, "one"), (2, "two"), (3, "three")])
    landing = str(tmp_path / "landing")
    first = events_frame(spark, [event(5, "post", 1, 2, "updated"), event(6, "post", 2, 1, "created")])
    late = events_frame(spark, [event(1, "post", 1, 1, "created"), event(2, "post", 3, 1, "created"),
                                event(6, "post", 2, 1, "created")])
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    seen = []

    def run():
        feed = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        streaming.run_projection_stream(
            feed, store, lambda: source, lambda _: "2024-06-01", str(tmp_path / "c"),
            on_outcomes=lambda o, b: seen.extend((r.id, r.outcome) for r in o.collect()),
        ).awaitTermination()

    first.coalesce(1).write.mode("append").parquet(landing)
    run()
    late.coalesce(1).write.mode("append").parquet(landing)
    run()
    assert titles(store) == {1: ("one", False), 2: ("two", False), 3: ("three", False)}
    # The late but newer-than-nothing event counts, the late older and the repeated ones do not.
    assert sorted(seen) == [("e0001", "stale"), ("e0002", "applied"), ("e0005", "applied"),
                            ("e0006", "applied"), ("e0006", "stale")]
    assert store.state().ledger.count() == 3


def test_progress_listener(spark, tmp_path):
    listener = streaming.ProgressTable(spark, str(tmp_path / "p"))
    spark.streams.addListener(listener)
    try:
        events_frame(spark, [event(1, "post", 1, 1, "created")]).write.parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(events_frame(spark, []).schema).parquet(str(tmp_path / "in"))
        feed.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start().awaitTermination()
        import time

        for _ in range(50):
            if (tmp_path / "p" / "_SUCCESS").exists():
                break
            time.sleep(0.2)
        assert spark.read.parquet(str(tmp_path / "p")).agg(F.sum("rows")).first()[0] == 1
    finally:
        spark.streams.removeListener(listener)


def test_failed_events_are_retried_then_given_up(spark, tmp_path):
    store = ProjectionStore(spark, str(tmp_path / "s"), SPECS)
    path = str(tmp_path / "f")
    feed = events_frame(spark, [event(1, "post", 1, 1, "created"), event(2, "post", 2, 1, "created")])
    sink = streaming.failure_sink(path, lambda: feed, lambda b: f"2024-06-0{b + 1}")
    nothing = source_frame(spark, [])
    sink(store.apply(feed, nothing, "2024-06-01", batch=0), 0)
    waiting = streaming.read_attempts(spark, path).collect()
    assert {(r.event_id, r.attempts, r.last_error) for r in waiting} == {
        ("e0001", 1, "orphan"), ("e0002", 1, "orphan")}
    # Post 1 turns up before the retry; post 2 fails once more.
    found = source_frame(spark, [(1, "one")])
    retried = streaming.failure_sink(path, lambda: feed, lambda b: "2024-06-02", feed="retry")
    retried(streaming.retry_due(store, path, feed, found, "2024-06-02", batch=0), 0)
    assert {(r.event_id, r.attempts) for r in streaming.read_attempts(spark, path).collect()} == {("e0002", 2)}
    assert titles(store) == {1: ("one", False)}
