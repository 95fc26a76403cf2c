"""Small behaviour cases of the single operators."""

import pytest
from pyspark.sql import functions as F

from feedproj.operators import capture, chains, failures, guards, listing, ops, skew
from feedproj.operators.canonical import POST
from feedproj.plans.fixtures import Tables
from feedproj.plans.registered_rows import canonical, stored_posts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("old,new,want", [
    ("draft", "publish", "created"), (None, "publish", "created"), ("future", "publish", "created"),
    ("publish", "publish", "updated"), ("publish", "draft", "deleted"), ("publish", "trash", "deleted"),
    ("publish", "private", "deleted"), ("publish", None, "deleted"), ("draft", "pending", None),
    ("pending", "trash", None), (None, None, None),
])
def test_transitions(spark, old, new, want):
    df = spark.createDataFrame([(old, new)], "o string, n string")
    assert df.select(capture.classify_transition(F.col("o"), F.col("n")).alias("a")).first()["a"] == want


def test_request_emits(spark):
    emits = spark.createDataFrame([
        ("r1", 1, "transition", "a"), ("r1", 1, "save", "b"), ("r1", 1, "trash", "c"),
        ("r1", 1, "hard_delete", "d"), ("r2", 1, "save", "e"), ("r1", 2, "trash", "f")],
        "request_id string, post_id int, hook string, tag string")
    kept = {r.tag for r in capture.collapse_request_emits(emits).collect()}
    assert kept == {"a", "d", "e", "f"}


@pytest.mark.parametrize("attempt,low,high", [
    (1, 30, 37), (2, 60, 75), (3, 120, 150), (8, 3600, 4500), (60, 3600, 4500), (0, 0, 0), (-1, 0, 0)])
def test_backoff(spark, attempt, low, high):
    df = spark.range(200).select(failures.backoff_seconds(
        F.lit(attempt), F.col("id").cast("string")).alias("s"))
    got = df.agg(F.min("s"), F.max("s")).first()
    assert low <= got[0] <= got[1] <= high


def test_unknown_partition(spark):
    with pytest.raises(ValueError):
        failures.eligible(spark.createDataFrame([], "queue_name string"), "2024-01-01", "nope")


def test_route_failures(spark):
    outcomes = spark.createDataFrame([
        ("a", "content.post.created", "orphan"), ("b", "content.post.created", "rejected"),
        ("c", "content.post.created", "applied")], "id string, event_type string, outcome string")
    events = spark.createDataFrame([("a", '{"x":1}'), ("b", "oops"), ("c", "{}")], "id string, payload string")
    attempts = spark.createDataFrame([
        ("b", "content", 9, None, None, "x"), ("c", "content", 2, None, None, "x"),
        ("d", "content", 1, None, None, "x")],
        "event_id string, queue_name string, attempts int, available_at timestamp, deadline timestamp,"
        "last_error string")
    waiting, dead = failures.route_failures(outcomes, events, attempts, "2024-01-01")
    assert {(r.event_id, r.attempts) for r in waiting.collect()} == {("a", 1), ("d", 1)}
    row = dead.first()
    assert (row.event_id, row.attempt_count, row.payload_snapshot) == ("b", 10, '{"raw":"oops"}')


def test_stale_guard_cases(spark):
    events = spark.createDataFrame([
        ("a", "post", "1", 5), ("b", "post", "1", 4), ("c", "post", "1", 6), ("d", "post", "2", 1)],
        "id string, aggregate_type string, aggregate_id string, aggregate_version bigint")
    versions = spark.createDataFrame([("post", "1", 5)],
                                     "aggregate_type string, aggregate_id string, latest_processed_version bigint")
    fresh, stale = guards.stale_guard(events, versions)
    assert {r.id for r in fresh.collect()} == {"c", "d"}
    assert {r.id for r in stale.collect()} == {"a", "b"}


def test_number_within_hot_equals_plain(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"),
        F.timestamp_seconds(F.lit(1700000000) + (F.col("id") * 7919) % 9000).alias("t"), "id")
    cut = skew.number_within(df, ["k"], ["t", "id"], "n", rows=200)
    plain = skew.number_within(df, ["k"], ["t", "id"], "n")
    assert rows(cut.select("id", "n")) == rows(plain.select("id", "n"))


def test_a_hot_minute_is_numbered_in_many_tasks(spark):
    """One aggregate, one minute: its rows lie in several range partitions, versions are without a gap."""
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(1700000000)).alias("t"), "id").repartition(7)
    cut = skew.number_within(df, ["k"], ["t", "id"], "n", rows=500)
    assert [r.n for r in cut.orderBy("id").select("n").collect()] == list(range(1, 4001))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        tasks = skew.running_sum(df.withColumn("one", F.lit(1)), ["k"], [F.col("t"), F.col("id")], "one", "before")
        assert tasks.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset(coalesce)


def test_running_sum_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", 2, 2), ("a", 3, 4)], "k string, o int, v bigint")
    got = {(r.k, r.o): r.s for r in skew.running_sum(df, ["k"], [F.col("o")], "v", "s").collect()}
    assert got == {(None, 1): 0, (None, 2): 5, ("a", 1): 0, ("a", 2): 1, ("a", 3): 3}
    alone = {r.o: r.s for r in skew.running_sum(df.where("k = 'a'"), [], [F.col("o")], "v", "s").collect()}
    assert alone == {1: 0, 2: 1, 3: 3}


def test_salted_lookup_keeps_all_rows(spark):
    many = spark.range(3000).select((F.col("id") % 2).alias("k"), "id")
    one = spark.createDataFrame([(0, "zero")], "k bigint, v string")
    got = skew.salted_lookup(many, one, ["k"], ["id"], rows=100)
    assert got.count() == 3000 and got.where("v = 'zero'").count() == 1500


def test_chains(spark):
    long = [(f"n{i}", f"n{i-1}" if i else None) for i in range(100)]
    odd = [("o1", "gone"), ("o2", "o1"), ("c1", "c3"), ("c2", "c1"), ("c3", "c2"), ("tail", "c1"), ("self", "self")]
    df = spark.createDataFrame(long + odd, "k string, p string")
    got = {r.k: r for r in chains.resolve_chains(df, "k", "p", rows=20).collect()}
    assert len(got) == len(long + odd)
    assert all(got[f"n{i}"].depth == i and got[f"n{i}"].root == "n0" for i in range(100))
    assert got["n3"].path == "n0/n1/n2/n3"
    assert (got["o2"].state, got["o2"].root, got["o2"].depth) == ("orphan", "o1", 1)
    assert {k for k, r in got.items() if r.state == "cycle"} == {"c1", "c2", "c3", "tail", "self"}


def posts(spark, n=5):
    return spark.createDataFrame(
        [(f"{i:02d}", f"s{i}", "publish" if i != 3 else "draft", "2024-01-01 00:00:00", None) for i in range(n)],
        "id string, slug string, status string, at string, deleted_at timestamp"
    ).withColumn("published_at", F.col("at").cast("timestamp")).withColumn("updated_at", F.col("published_at"))


def test_keyset_walk_equals_one_listing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    visible = listing.visible(t.fx_posts).where("published_at > '1998-01-01'").select(
        "id", "slug", "status", "deleted_at", "published_at", "updated_at")
    walked, token = [], None
    small = spark.createDataFrame(visible.collect(), visible.schema)
    while True:
        page = listing.list_posts(small, cursor=token, limit=100)
        walked += [r.slug for r in page.rows.collect()]
        token = page.next_cursor()
        if token is None:
            break
    assert walked == [r.slug for r in small.orderBy(*listing.newest_first()).collect()]


def test_same_timestamp_pages(spark):
    df = posts(spark, 6)
    sizes, seen, token = [], set(), None
    while True:
        page = listing.list_posts(df, cursor=token, limit=2)
        got = [r.slug for r in page.rows.collect()]
        sizes.append(len(got))
        seen |= set(got)
        token = page.next_cursor()
        if token is None:
            break
    assert sizes == [2, 2, 1] and len(seen) == 5


def test_listing_arguments(spark):
    assert listing.clamp_limit(None, "post") == 20 and listing.clamp_limit(0, "post") == 20
    assert listing.clamp_limit(500, "post") == 100 and listing.clamp_limit(500, "category") == 200
    with pytest.raises(ValueError):
        listing.list_posts(posts(spark), status="draft")
    with pytest.raises(ValueError):
        listing.list_posts(posts(spark), cursor="bm90IGEgY3Vyc29y")
    with pytest.raises(ValueError):
        listing.list_posts(posts(spark), published_after="someday")
    loose = listing.list_posts(posts(spark), cursor="bm90IGEgY3Vyc29y", published_after="someday", strict=False)
    assert loose.rows.count() == 4
    assert listing.find_by_slug(posts(spark), "s3").count() == 0


def test_category_filter_unknown_slug(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert listing.list_posts(t.fx_posts, t.fx_bridge, t.fx_taxonomies, category_slug="none").rows.count() == 0


def test_reconcile_leaves_no_drift(spark, sf_dir):
    t = Tables(spark, sf_dir)
    now = canonical(t, POST).where("author not like '%1'")
    fixed = ops.reconcile(now, stored_posts(t).where("author not like '%2'"), POST, "2024-06-01")
    from feedproj.session import checkpointed

    assert ops.detect_drift(now, checkpointed(fixed), POST).count() == 0


def test_invalid_source_rows_are_not_removed(spark, sf_dir):
    from feedproj.session import checkpointed

    t = Tables(spark, sf_dir)
    stored, rows = checkpointed(stored_posts(t)), checkpointed(canonical(t, POST))
    live = [r[0] for r in stored.where("deleted_at is null").join(
        rows.select(F.col(POST.key).alias(POST.natural_key)), POST.natural_key, "left_semi"
    ).select(POST.natural_key).orderBy(POST.natural_key).limit(3).collect()]
    invalid, gone = live[:2], live[2]
    valid = rows.where(~F.col(POST.key).isin(live))
    source = rows.where(F.col(POST.key) != gone).select(POST.key)
    drift = {r[0]: r[1] for r in ops.detect_drift(valid, stored, POST, source).collect()}
    assert [drift[k] for k in live] == ["invalid", "invalid", "extra"]
    assert ops.detect_drift(valid, stored, POST).where("drift = 'invalid'").count() == 0
    fixed = ops.reconcile(valid, stored, POST, "2024-06-01", source)
    same = stored.where(F.col(POST.natural_key).isin(invalid))
    assert fixed.where(F.col(POST.natural_key).isin(invalid)).exceptAll(same.select(fixed.columns)).count() == 0
    assert fixed.where((F.col(POST.natural_key) == gone) & F.col("deleted_at").isNotNull()).count() == 1


def explained(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_plans(spark, sf_dir, capsys):
    """Filters reach the scan, listings end in a top-k, reductions combine before the shuffle."""
    from feedproj.session import checkpointed

    t = Tables(spark, sf_dir)
    stored = checkpointed(t.fx_posts)
    plan = explained(listing.list_posts(stored, published_after="1996-01-01").rows.select("slug"), capsys)
    pushed = plan.split("PushedFilters: [")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in plan
    assert "IsNull(deleted_at)" in pushed and "EqualTo(status,publish)" in pushed
    assert "GreaterThan(published_at" in pushed
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]
    reduced = explained(guards.reduce_aggregates(checkpointed(t.fx_feed)), capsys)
    assert "partial_max" in reduced and "HashAggregate" in reduced and "SortAggregate" not in reduced
