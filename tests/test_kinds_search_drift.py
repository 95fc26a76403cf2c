"""Registration of kinds, survivors among copies, joins and ranks by lists, drift by ranges, timers."""

import dataclasses
import os
import sys

import pytest
from pyspark.sql import functions as F
from test_apply import event, events_frame, source_frame

from feedproj.functions import text
from feedproj.operators import canonical as C
from feedproj.operators import commerce, digests, failures, guards, listing, ops, search
from feedproj.operators.kinds import CONTENT_KINDS, Kinds
from feedproj.plans.apply import ProjectionState, apply_batch
from feedproj.session import shared_dir
from feedproj.sources.feed import append_events
from feedproj.streaming import operations as streaming_ops
from feedproj.streaming import projection as streaming

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- kinds --------------------------------------------------------------------------------


def test_content_kinds_are_the_nine_types():
    assert set(CONTENT_KINDS.event_types) == {
        f"content.{kind}.{verb}" for kind in ("page", "post", "category") for verb in ("created", "updated", "deleted")}
    with pytest.raises(ValueError):
        Kinds((C.POST, C.POST))
    with pytest.raises(ValueError):
        Kinds((C.POST, dataclasses.replace(C.PAGE, kind="post")))
    assert CONTENT_KINDS.with_(C.CONTENT) == CONTENT_KINDS


def test_a_kind_declares_its_own_verbs(spark):
    stock = dataclasses.replace(commerce.PRODUCT, kind="stock", upserts=("counted",), tombstones=("dropped", "lost"))
    kinds = CONTENT_KINDS.with_([stock])
    names = ["commerce.stock.counted", "commerce.stock.lost", "commerce.stock.created", "content.post.deleted", "content.stock.counted", None]
    rows = spark.createDataFrame([(n,) for n in names], "event_type string").select(
        kinds.registered(F.col("event_type")), kinds.action(F.col("event_type")), kinds.aggregate_type(F.col("event_type"))).collect()
    assert [tuple(r) for r in rows] == [
        (True, "upsert", "stock"), (True, "tombstone", "stock"), (False, None, "stock"), (True, "tombstone", "post"),
        (False, None, None), (False, None, None)]


def test_a_registered_kind_is_applied_and_an_unknown_one_fails(spark):
    products = spark.createDataFrame(
        [("1", "S1", "one", "One", "", "publish", "SIMPLE", "9.50", None, "EUR", "instock", "true", ["4"], ["7"]),
         ("2", "S2", "two", "Two", "", "publish", "SIMPLE", "1", None, "EUR", "instock", "no", [], [])],
        "product_id string, sku string, slug string, name string, description string, status string, product_type string, "
        "price string, sale_price string, currency string, stock_status string, featured string, "
        "category_ids array<string>, attribute_term_ids array<string>")
    terms = spark.createDataFrame([("7", "1", "Red", "red")], "term_id string, attribute_id string, name string, slug string")
    categories = spark.createDataFrame([("4", "Shoes", "shoes", "")], "term_id string, name string, slug string, description string")
    source = dataclasses.replace(source_frame(spark, []), extra={"product": products, "attribute_term": terms, "commerce_category": categories})
    feed = events_frame(spark, [event(k, "post", k, 1, "created") for k in (1, 2, 4, 7, 9)])

    def as_kind(row_id, kind, key, verb="created"):
        return feed.where(F.col("id") == f"e{row_id:04d}").withColumn("event_type", F.lit(f"commerce.{kind}.{verb}")).withColumn(
            "aggregate_type", F.lit(kind)).withColumn("aggregate_id", F.lit(key))

    batch = as_kind(1, "product", "1").union(as_kind(2, "product", "2")).union(as_kind(4, "commerce_category", "4")).union(
        as_kind(7, "attribute_term", "7")).union(as_kind(9, "coupon", "1"))
    specs = (commerce.COMMERCE_CATEGORY, commerce.ATTRIBUTE_TERM, commerce.PRODUCT)
    state, outcomes = apply_batch(batch, ProjectionState.empty(spark, specs), source, "2024-06-01", specs=specs)
    assert {r.id: r.outcome for r in outcomes.collect()} == {
        "e0001": "applied", "e0002": "applied", "e0004": "applied", "e0007": "applied", "e0009": "unregistered"}
    assert {r.name: str(r.price) for r in state.entities["product"].collect()} == {"One": "9.50", "Two": "1.00"}
    ids = {r.id for k in ("commerce_category", "attribute_term") for r in state.entities[k].collect()}
    assert {r.taxonomy_id for r in state.bridge.collect()} == ids and len(ids) == 2
    _, plain = apply_batch(batch, ProjectionState.empty(spark), source_frame(spark, []), "2024-06-01")
    assert {r.outcome for r in plain.collect()} == {"unregistered"}


# --- survivors among copies -----------------------------------------------------------------


@pytest.mark.parametrize("order", [1, -1])
def test_one_whole_copy_stays_in_any_order(spark, order):
    rows = [event(1, "post", 1, 2, "updated"), event(1, "post", 1, 1, "created"), event(2, "post", 2, 1, "created")]
    feed = events_frame(spark, rows[::order]).coalesce(1)
    feed = feed.withColumn("payload", F.concat(F.lit("v"), F.col("aggregate_version").cast("string")))
    empty = feed.limit(0)
    for got in (append_events(feed, empty), guards.dedup_exact(feed, empty.select(F.col("id").alias("event_id")))):
        found = {r.id: (r.aggregate_version, r.event_type, r.payload) for r in got.collect()}
        assert found["e0001"] == (1, "content.post.created", "v1") and len(found) == 2
    state, outcomes = apply_batch(feed, ProjectionState.empty(spark), source_frame(spark, [(1, "one"), (2, "two")]), "2024-06-01")
    one = next(r for r in outcomes.collect() if r.id == "e0001")
    assert (one.aggregate_version, one.event_type, one.deliveries) == (1, "content.post.created", 2)


def test_slug_with_two_rows(spark):
    df = spark.createDataFrame([("b", "s", None, "publish"), ("a", "s", None, "publish")], "id string, slug string, deleted_at timestamp, status string")
    assert [r.id for r in listing.find_by_slug(df, "s").collect()] == ["a"]


def test_loose_numbers(spark):
    said = ["12", "12abc", " 7", "-3x", "1e3", "2.9", "x", "", None, "99999999999999999999"]
    df = spark.createDataFrame([(said,)], "v array<string>")
    assert df.select(text.id_list(F.col("v"))).first()[0] == [12, 12, 7, -3, 1000, 2, 0, 0, 0, 0]


# --- search ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def titles(spark):
    words = ["small", "rings", "blue", "bolt", "gear", "gizmo", "widget", "hot", "smell", "ring"]
    rows = [(k, " ".join(words[(k * p + k // 7) % 10] for p in (1, 3, 7)[: 1 + k % 3])) for k in range(200)]
    return spark.createDataFrame([*rows, (200, None), (201, "!!"), (202, "small rings")], "id int, title string")


@pytest.mark.parametrize("hot", [5, 1_000_000])
@pytest.mark.parametrize("at_least", [0.3, 0.75, 1.0])
def test_similar_join_is_similar_for_every_query(titles, hot, at_least):
    asked = titles.where("id % 20 = 0 or id > 199").withColumnRenamed("id", "q")
    got = search.similar_join(titles, "id", F.col("title"), asked, "q", F.col("title"), at_least, rows=hot)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = set()
    for q in asked.collect():
        if q.title and q.title != "!!":
            want |= {(q.q, r.id, r.similarity) for r in search.similar(titles, F.col("title"), q.title, at_least).collect()}
    rows = [tuple(r) for r in got.select("q", "id", "similarity").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def brute_force(rows, asked, at_least):
    """Every pair, by Python sets of the trigrams that :func:`search.trigrams` gives."""
    out = []
    for q, mine in asked:
        for k, other in rows:
            shared = len(mine & other)
            if mine and other and round(shared / (len(mine) + len(other) - shared), 6) >= at_least:
                out.append((q, k, round(shared / (len(mine) + len(other) - shared), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [7, 1_000_000])
def test_similar_join_compares_equal_titles_once(spark, monkeypatch, hot):
    said = ["red bolt", "Bolt RED", "red bolts", "hot rod", None]
    docs = spark.createDataFrame([(k if k % 50 else None, said[k % 5]) for k in range(600)] + [(7, "red bolts")], "id int, title string")
    asked = spark.createDataFrame([(k % 30, said[k % 5]) for k in range(45)], "q int, title string")
    staged = []
    kept = search.checkpointed
    monkeypatch.setattr(search, "checkpointed", lambda df: staged.append(kept(df)) or staged[-1])
    got = [tuple(r) for r in search.similar_join(docs, "id", F.col("title"), asked, "q", F.col("title"), 0.6, rows=hot).collect()]
    sets = lambda df, k: [(r[0], set(r[1])) for r in df.select(k, F.coalesce(search.trigrams(F.col("title")), F.array())).collect()]
    assert sorted(got, key=str) == brute_force(sets(docs, "id"), sets(asked, "q"), 0.6)
    # Three sets of trigrams: two titles differ in order and case only.
    lists = [df for df in staged if "place" in df.columns]
    assert [df.select("row").distinct().count() for df in lists] == [3]


def test_similar_join_of_short_and_long_texts(spark):
    words = ["gear", "gears", "großer", "мир", "мира", "ring", "rings", "x", "plate", "größe"] + [f"w{k * 7919 % 1000}" for k in range(300)]
    rows = [(k, " ".join(words[(k // 3 + j * (1 + k % 3)) % 310] for j in range((3, 40, 400)[k % 3]))) for k in range(120)]
    docs = spark.createDataFrame(rows, "id int, title string")
    asked = docs.where("id % 4 = 0").withColumnRenamed("id", "q")
    sets = lambda df, k: [(r[0], set(r[1])) for r in df.select(k, search.trigrams(F.col("title"))).collect()]
    for at_least in (0.3, 0.6):
        got = search.similar_join(docs, "id", F.col("title"), asked, "q", F.col("title"), at_least)
        assert sorted(map(tuple, got.collect()), key=str) == brute_force(sets(docs, "id"), sets(asked, "q"), at_least)


def test_search_top_reads_few_blocks(spark, tmp_path):
    docs = spark.range(6000).select("id", F.concat_ws(" ", F.array_repeat(F.lit("common"), (1 + F.col("id") % 37).cast("int")), F.when(
        F.col("id") % 11 == 0, "rare rare")).alias("body"))
    index = search.inverted_index(docs, "id", F.col("body"))
    search.write_block_index(index, "id", str(tmp_path / "i"), block=16, buckets=4)
    blocks = spark.read.parquet(str(tmp_path / "i"))
    read, _ = search.blocks_to_read(blocks, "id", ["common", "rare"], 6000, 10, buckets=4)
    assert read.count() < blocks.count() / 3
    top = [tuple(r) for r in search.search_top(blocks, "id", ["common", "rare"], 6000, 10, buckets=4).collect()]
    whole = search.search(docs, F.col("body"), ["common", "rare"]).orderBy(F.col("rank").desc(), "id").limit(10)
    assert top == [(r.id, r.rank) for r in whole.collect()]
    assert search.search_top(blocks, "id", ["absent"], 6000, 10, buckets=4).collect() == []
    assert search.search_top(blocks, "id", ["--"], 6000, 10, buckets=4).collect() == []
    assert len(search.search_top(blocks, "id", ["rare"], 6000, 100_000, buckets=4).collect()) == 546


@pytest.mark.parametrize("hot", [40, 1_000_000])
def test_a_block_index_counts_words_once(spark, tmp_path, hot):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(body):
        read.add(1)
        return body

    docs = spark.range(300).select((F.col("id") % 290).alias("id"), F.concat_ws(" ", F.array_repeat(F.lit("common"), (1 + F.col("id") % 7).cast("int")), F.when(
        F.col("id") % 11 == 0, "rare Rare")).alias("body"))
    index = search.inverted_index(docs.withColumn("body", told.asNondeterministic()("body")), "id", F.col("body"))
    before = set(os.listdir(f"{shared_dir(spark)}/staged")) if os.path.isdir(f"{shared_dir(spark)}/staged") else set()
    search.write_block_index(index, "id", str(tmp_path / "i"), block=16, buckets=4, rows=hot)
    assert read.value == 300
    if hot > 300:
        assert set(os.listdir(f"{shared_dir(spark)}/staged")) == before
    whole = search.inverted_index(docs, "id", F.col("body")).collect()
    blocks = spark.read.parquet(str(tmp_path / "i")).collect()
    assert sorted((b.term, p.id, p.tf) for b in blocks for p in b.postings) == sorted(map(tuple, whole))
    for term in ("common", "rare"):
        mine = sorted((b for b in blocks if b.term == term), key=lambda b: b.block)
        asked = sorted(((-r.tf, r.id) for r in whole if r.term == term))
        assert [len(b.postings) for b in mine[:-1]] == [16] * (len(mine) - 1) and {b.n_rows for b in mine} == {len(asked)}
        for k, b in enumerate(mine):
            assert sorted((-p.tf, p.id) for p in b.postings) == asked[16 * k:16 * k + 16] and b.max_tf == max(p.tf for p in b.postings)


# --- percentiles and drift ------------------------------------------------------------------


def test_sync_delay_has_no_percentile_buffer(spark):
    feed = spark.range(1000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "a").alias("event_type"),
        F.timestamp_seconds(F.lit(0)).alias("source_updated_at"))
    ledger = spark.range(1000).select(F.col("id").cast("string").alias("event_id"), F.when(
        F.col("id") > 3, F.timestamp_seconds((F.col("id") * 7919) % 613)).alias("processed_at"))
    got = ops.sync_delay(feed, ledger)
    assert "percentile" not in got._jdf.queryExecution().toString()
    plain = feed.join(ledger, F.col("id") == F.col("event_id")).select(
        "event_type", (F.unix_seconds("processed_at") - F.unix_seconds("source_updated_at")).alias("d"))
    want = plain.groupBy("event_type").agg(F.count(F.lit(1)), *[
        F.expr(f"percentile_disc({p}) within group (order by d)").cast("bigint") for p in (0.5, 0.95, 0.99)],
        F.max("d"), F.count(F.when(F.col("d") > 30, 1)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_drift_is_looked_for_where_digests_differ(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.col("id").alias("post_id"), F.lit("publish").alias("status"), F.sha2(F.col("id").cast("string"), 256).alias("checksum"))
    shown = rows.select(F.col("post_id").alias("source_post_id"), "checksum", F.lit(None).cast("timestamp").alias("deleted_at"))
    shown.where("source_post_id not in (5, 9000)").withColumn("checksum", F.when(
        F.col("source_post_id") == 15_000, "other").otherwise(F.col("checksum"))).repartitionByRange(4, "source_post_id").sortWithinPartitions(
        "source_post_id").write.parquet(str(tmp_path / "p"))
    projection = spark.read.parquet(str(tmp_path / "p"))
    canonical = rows.where("post_id <> 19999")
    left, right = digests.source_digests(canonical, C.POST, 6), digests.projection_digests(projection, C.POST, 6)
    leaves = digests.differing_leaves(left, right)
    assert sorted(r.leaf for r in leaves.collect()) == sorted({5 >> 6, 9000 >> 6, 15_000 >> 6, 19_999 >> 6})
    near = digests.rows_in(projection, "source_post_id", leaves, 6)
    assert near.count() < 4 * 64
    assert "GreaterThanOrEqual(source_post_id" in near._jdf.queryExecution().toString()
    got = digests.detect_drift_ranges(canonical, projection, C.POST, leaf_bits=6)
    assert sorted(map(tuple, got.collect())) == [(5, "missing"), (9000, "missing"), (15_000, "changed"), (19_999, "extra")]
    raw = spark.createDataFrame([(19_999,)], "id bigint")
    assert (19_999, "invalid") in set(map(tuple, digests.detect_drift_ranges(canonical, projection, C.POST, raw, leaf_bits=6).collect()))
    # Without a difference nothing is read.
    assert digests.detect_drift_ranges(rows, shown, C.POST, leaf_bits=6).count() == 0


# --- streams --------------------------------------------------------------------------------


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def test_stale_filter_starts_from_the_version_table(spark, tmp_path, rocks):
    feed = events_frame(spark, [event(v, "post", 1, v, "updated") for v in range(1, 8)] + [event(20, "post", 2, 1, "created")])
    feed.coalesce(1).write.parquet(str(tmp_path / "in"))
    versions = spark.createDataFrame([("post", "1", 4), ("post", "3", 9)], "aggregate_type string, aggregate_id string, latest_processed_version bigint")
    stream = streaming.stale_filter_stream(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in")), versions)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(
        str(tmp_path / "out")).awaitTermination()
    assert sorted((r.aggregate_id, r.aggregate_version) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [
        ("1", 5), ("1", 6), ("1", 7), ("2", 1)]
    state = spark.read.format("statestore").option("stateVarName", "latest").load(str(tmp_path / "c"))
    kept = {r["key"]["aggregate_id"]: r["value"]["version"] for r in state.collect()}
    assert kept == {"1": 7, "2": 1, "3": 9}


def test_retry_stream_lets_go_what_is_eligible(spark, sf_dir):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
    from feedproj.plans.fixtures import Tables
    from feedproj.plans.registered_ops import LATER
    from feedproj.plans.registry import QUERIES

    attempts = Tables(spark, sf_dir).fx_attempts
    got = {(r.event_id, r.attempts) for r in QUERIES["retry_stream"](spark, sf_dir).collect()}
    far = F.col("event_id").endswith("7")
    table = attempts.withColumn("available_at", F.when(far, F.lit(LATER).cast("timestamp")).otherwise(F.col("available_at")))
    due = {r.event_id: r.attempts for q in ("content", "commerce") for r in failures.eligible(table, "2026-01-01 00:00:00", q).collect()}
    # Of an event's two attempts the later one replaces the one that waits.
    assert got == {(e, n + 1) for e, n in due.items()}
    assert streaming_ops._millis(None) == 1
