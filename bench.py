"""Headline timings on the driver tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Inputs a query needs beforehand (earlier projections, the
event store) are written once, outside the timings.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from feedproj.functions import shape  # noqa: E402
from feedproj.operators import canonical as C  # noqa: E402
from feedproj.operators import capture, guards, listing, ops, projection, search  # noqa: E402
from feedproj.plans import registered_feed, registered_rows  # noqa: E402
from feedproj.plans.fixtures import AS_OF, Tables  # noqa: E402
from feedproj.session import build_session, checkpointed  # noqa: E402
from feedproj.sources.state import SourceState, load_source_state  # noqa: E402
from feedproj.sources.store import ProjectionStore  # noqa: E402
from feedproj.streaming import projection as streaming  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def whole(df) -> None:
    """Compute every row and column, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, SF)
    timed: dict[str, float] = {}
    facts: dict[str, float] = {}

    def clock(name: str, run) -> None:
        start = time.time()
        run()
        timed[name] = round(time.time() - start, 3)
        print(f"{name} {timed[name]}", file=sys.stderr, flush=True)

    # What exists before: the source as tables, the event store, the earlier projection.
    source = SourceState(*[checkpointed(df) for df in (
        t.src_posts, t.src_pages, t.src_terms, t.src_meta, t.src_post_terms)])
    events, stored = checkpointed(t.fx_feed), checkpointed(registered_rows.stored_posts(t))
    posts, bridge, terms = (checkpointed(df) for df in (t.fx_posts, t.fx_bridge, t.fx_taxonomies))
    edits = checkpointed(t.sql(registered_feed.EDITS))
    counters = checkpointed(t.sql(registered_feed.COUNTERS))
    versions, ledger = checkpointed(t.fx_versions), checkpointed(t.fx_ledger)
    n_events, n_posts = events.count(), source.posts.count()

    def now():
        return C.canonical_rows(load_source_state(source, C.POST), C.POST, AS_OF)

    clock("canonical_posts", lambda: whole(now()))
    clock("capture_envelopes", lambda: whole(
        capture.build_envelope(capture.assign_versions(edits, counters), AS_OF)))
    clock("dedup_exact", lambda: whole(guards.dedup_exact(events.unionByName(events), ledger)))
    clock("stale_guard_reduce", lambda: whole(guards.reduce_aggregates(guards.stale_guard(events, versions)[0])))

    store = ProjectionStore(spark, registered_feed.scratch(t, "store"))
    clock("apply_batch_to_store", lambda: store.apply(events, source, AS_OF, batch=0))
    clock("apply_redelivered_batch", lambda: store.apply(events, source, AS_OF, batch=1))
    facts["events_applied_per_sec"] = round(n_events / timed["apply_batch_to_store"])

    clock("detect_drift", lambda: whole(ops.detect_drift(now(), stored, C.POST)))
    clock("reconcile_full", lambda: whole(ops.reconcile(now(), stored, C.POST, AS_OF)))
    facts["entities_reconciled_per_sec"] = round(n_posts / timed["reconcile_full"])
    clock("upsert_posts", lambda: whole(projection.upsert_rows(stored, now(), C.POST, AS_OF)))

    def first_page():
        page = listing.list_posts(posts, bridge, terms, published_after="1995-03-01", category_slug="nation-13")
        whole(shape.shape_post(page.rows))
        return page.next_cursor()

    clock("list_first_page_in_category", first_page)
    token = first_page()
    clock("list_second_page_in_category", lambda: whole(shape.shape_post(listing.list_posts(
        posts, bridge, terms, published_after="1995-03-01", category_slug="nation-13", cursor=token).rows)))
    clock("find_by_slug", lambda: whole(listing.find_by_slug(posts, "order-32")))
    clock("paginate_all", lambda: whole(listing.paginate_all(
        listing.visible(posts), 20, listing.newest_first(), "published_at")))
    clock("feed_metrics", lambda: whole(ops.feed_metrics(
        events, ledger, t.fx_attempts, t.fx_attempts.where("attempts >= 10"), AS_OF)))
    clock("search", lambda: whole(search.search(t.documents, F.col("text"), ["the", "les", "sch"])))

    # Four micro-batches of the feed: seconds per batch against the 30 s target.
    landing = registered_feed.scratch(t, "landing")
    cuts = ["2024-01-08", "2024-01-15", "2024-01-23", "2025-01-01"]
    low = "2000-01-01"
    for high in cuts:
        events.where((F.col("created_at") >= low) & (F.col("created_at") < high)).coalesce(1).write.mode(
            "append").parquet(landing)
        low = high
    streamed = ProjectionStore(spark, registered_feed.scratch(t, "stream-store"))

    def stream():
        feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        streaming.run_projection_stream(
            feed, streamed, lambda: source, lambda _: AS_OF, registered_feed.scratch(t, "stream")
        ).awaitTermination()

    clock("projection_stream_4_batches", stream)
    facts["stream_seconds_per_batch"] = round(timed["projection_stream_4_batches"] / len(cuts), 2)

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": SF, "cpus": int(CPUS), "rows": {"events": n_events, "posts": n_posts}, **facts,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
