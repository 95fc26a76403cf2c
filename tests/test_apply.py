"""The set-based apply against a slow one-event-at-a-time model."""

import random

import pytest
from pyspark.sql import functions as F

from feedproj.plans.apply import ProjectionState
from feedproj.plans.apply import apply_batch as apply_lazily
from feedproj.session import checkpointed
from feedproj.sources.state import SourceState

EVENTS = ("id string, event_type string, event_version int, aggregate_type string, aggregate_id string,"
          "aggregate_version bigint, source_updated_at timestamp, checksum string, correlation_id string,"
          "causation_id string, payload string, created_at timestamp")
RAW_POST = ("ID string, post_type string, post_name string, post_status string, post_title string,"
            "post_content string, post_excerpt string, post_date_gmt string, post_modified_gmt string,"
            "post_author string, post_author_login string")
RAW_PAGE = ("ID string, post_type string, post_name string, post_status string, post_title string,"
            "post_content string, post_date_gmt string, post_modified_gmt string, post_parent string,"
            "menu_order string")
RAW_TERM = ("term_id string, name string, slug string, description string, parent string, count string,"
            "taxonomy string")


def apply_batch(*args, **options):
    return apply_lazily(*args, stage=checkpointed, **options)


def event(seq, kind, agg, version, verb, delete_at=None):
    at = f"2024-01-01 00:{seq // 60:02d}:{seq % 60:02d}"
    return (f"e{seq:04d}", f"content.{kind}.{verb}", 1, kind, str(agg), version,
            delete_at or at, f"sum{seq}", f"e{seq:04d}", None, "{}", at)


def events_frame(spark, rows):
    text = EVENTS.replace("timestamp", "string")
    df = spark.createDataFrame(rows, text)
    return df.withColumn("source_updated_at", F.col("source_updated_at").cast("timestamp")).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))


def source_frame(spark, posts=(), terms=(), post_terms=(), pages=()):
    """``posts``: (id, title or None for invalid slug)."""
    p = [(str(i), "post", "" if t is None else f"post-{i}", "publish", t or "", "c", "x",
          "2024-01-01 00:00:00", "2024-01-02 00:00:00", "1", "ann") for i, t in posts]
    g = [(str(i), "page", f"page-{i}", "publish", t, "c", "2024-01-01 00:00:00",
          "2024-01-02 00:00:00", "0", "0") for i, t in pages]
    c = [(str(i), n, f"cat-{i}", "", "0", "0", "category") for i, n in terms]
    return SourceState(
        spark.createDataFrame(p, RAW_POST), spark.createDataFrame(g, RAW_PAGE),
        spark.createDataFrame(c, RAW_TERM),
        spark.createDataFrame([], "post_id bigint, meta_id bigint, meta_key string, meta_value string"),
        spark.createDataFrame(list(post_terms), "post_id bigint, term_id bigint"),
    )


def content(state, kind="post"):
    key = "source_post_id" if kind != "category" else "source_term_id"
    title = "title" if kind != "category" else "name"
    return {
        r[key]: (r[title], str(r["deleted_at"]) if r["deleted_at"] else None, str(r["synced_at"]),
                 str(r["created_at"]))
        for r in state.entities[kind].collect()
    }


def versions(state):
    return {(r.aggregate_type, r.aggregate_id): r.latest_processed_version for r in state.versions.collect()}


class Serial:
    """The rules, one event at a time, in plain Python."""

    def __init__(self, source, resurrect):
        self.source, self.resurrect = source, resurrect
        self.rows, self.versions, self.ledger, self.outcome = {}, {}, set(), {}

    def run(self, events, as_of):
        for e in events:
            self.outcome[e[0]] = self.one(e, as_of)

    def one(self, e, as_of):
        agg, version, verb = int(e[4]), e[5], e[1].rsplit(".", 1)[1]
        if version <= self.versions.get(agg, -1):
            return "stale"
        if verb == "deleted":
            if agg in self.rows:
                self.rows[agg]["deleted_at"] = e[6]
        else:
            if agg not in self.source:
                return "orphan"
            title = self.source[agg]
            if title is None:
                return "rejected"
            row = self.rows.get(agg)
            if row is None:
                self.rows[agg] = dict(title=title, deleted_at=None, synced=as_of, created=as_of)
            elif row["title"] != title or (self.resurrect and row["deleted_at"]):
                row.update(title=title, deleted_at=None, synced=as_of)
        self.ledger.add(e[0])
        self.versions[agg] = max(version, self.versions.get(agg, 0))
        return "done"


def make_feed(rng, aggs, n):
    counters, feed = {}, []
    for seq in range(n):
        agg = rng.choice(aggs)
        counters[agg] = counters.get(agg, 0) + 1
        feed.append(event(seq, "post", agg, counters[agg], rng.choice(["created", "updated", "deleted"])))
    return feed


@pytest.mark.parametrize("resurrect,hot_rows", [(False, 1_000_000), (False, 3), (True, 3)])
def test_equals_serial_model(spark, resurrect, hot_rows):
    # With three rows to a task nearly every aggregate is hot and gets salted.
    rng = random.Random(11 + resurrect)
    aggs = list(range(1, 61))
    titles = {a: (None if a % 10 == 0 else f"t{a}") for a in aggs if a % 7}
    before = {a: (f"old{a}" if a % 3 else f"t{a}") for a in aggs if a % 2 and a % 10}
    feed = make_feed(rng, aggs, 300)
    half = 120

    # First batch from an older source, second from the current one.
    old_source = source_frame(spark, before.items())
    state = ProjectionState.empty(spark)
    model = Serial(before, resurrect)
    batches = [(feed[:half], old_source, before, "2024-05-01 00:00:00"),
               (feed[half:], source_frame(spark, titles.items()), titles, "2024-06-01 00:00:00")]
    for rows, source, titles_now, as_of in batches:
        model.source = titles_now
        model.run(sorted(rows, key=lambda e: (e[4], e[5])), as_of)
        shuffled = rows + rng.sample(rows, 20)
        rng.shuffle(shuffled)
        state, outcomes = apply_batch(
            events_frame(spark, shuffled), state, source, as_of, resurrect=resurrect, hot_rows=hot_rows)
        got = {r["id"]: r for r in outcomes.collect()}
        assert len(got) == len(rows)
        # Every fresh event that the model recorded is recorded, and no other.
        recorded = {i for i, r in got.items() if r["recorded"]}
        assert recorded == {e[0] for e in rows if model.outcome[e[0]] == "done"}
        state = ProjectionState(
            {k: spark.createDataFrame(v.collect(), v.schema) for k, v in state.entities.items()},
            *(spark.createDataFrame(x.collect(), x.schema) for x in (state.bridge, state.ledger, state.versions)))
    want = {a: (r["title"], r["deleted_at"], r["synced"], r["created"]) for a, r in model.rows.items()}
    assert content(state) == want
    assert versions(state) == {("post", str(a)): v for a, v in model.versions.items()}
    assert {r.event_id for r in state.ledger.collect()} == model.ledger
    # Applying the second batch again changes nothing.
    again, outcomes = apply_batch(
        events_frame(spark, feed[half:]), state, batches[1][1], "2024-07-01 00:00:00", resurrect=resurrect)
    assert content(again) == want
    assert {r.outcome for r in outcomes.collect()} <= {"stale", "orphan", "rejected"}


def test_small_cases(spark):
    source = source_frame(spark, [(1, "one"), (2, "two")], [(10, "A"), (20, "B")],
                          [(1, 10), (1, 20), (1, 99)], [(5, "page")])
    state = ProjectionState.empty(spark)
    feed = [event(1, "category", 10, 1, "created"), event(2, "category", 20, 1, "created"),
            event(3, "post", 1, 5, "updated"), event(4, "post", 1, 3, "updated"),
            event(5, "post", 3, 1, "deleted"), event(6, "page", 5, 1, "created"),
            event(7, "post", 4, 1, "created"), event(8, "widget", 1, 1, "created")]
    state, outcomes = apply_batch(events_frame(spark, feed), state, source, "2024-06-01 00:00:00")
    got = {r.id: r.outcome for r in outcomes.collect()}
    assert got == {"e0001": "applied", "e0002": "applied", "e0003": "applied", "e0004": "superseded",
                   "e0005": "applied", "e0006": "applied", "e0007": "orphan", "e0008": "unregistered"}
    # Unknown category 99 is left out; both recorded ids of post 1 are in the ledger.
    assert state.bridge.count() == 2
    assert {r.event_id for r in state.ledger.collect()} == {"e0001", "e0002", "e0003", "e0004", "e0005", "e0006"}
    assert versions(state)[("post", "1")] == 5 and versions(state)[("post", "3")] == 1
    assert content(state)[1][0] == "one" and 3 not in content(state)

    # A smaller category set replaces the links; a lower version is stale.
    smaller = source_frame(spark, [(1, "one!")], [(10, "A")], [(1, 10)])
    state2, outcomes = apply_batch(
        events_frame(spark, [event(20, "post", 1, 6, "updated"), event(21, "post", 1, 4, "updated")]),
        state, smaller, "2024-06-02 00:00:00")
    assert {r.id: r.outcome for r in outcomes.collect()} == {"e0020": "applied", "e0021": "stale"}
    assert state2.bridge.count() == 1
    assert content(state2)[1][3] == "2024-06-01 00:00:00"  # created_at survives


def test_late_link(spark):
    source = source_frame(spark, [(1, "one")], [(10, "A")], [(1, 10)])
    post_first = [event(1, "post", 1, 1, "created")]
    cat_later = [event(2, "category", 10, 1, "created")]
    for late, links in ((False, 0), (True, 1)):
        state = ProjectionState.empty(spark)
        state, _ = apply_batch(events_frame(spark, post_first), state, source, "2024-06-01", late_link=late)
        state, _ = apply_batch(events_frame(spark, cat_later), state, source, "2024-06-02", late_link=late)
        assert state.bridge.count() == links


def test_force_replay_repairs(spark):
    source = source_frame(spark, [(1, "one")])
    feed = [event(1, "post", 1, 1, "created"), event(2, "post", 1, 2, "updated")]
    state, _ = apply_batch(events_frame(spark, feed), ProjectionState.empty(spark), source, "2024-06-01")
    damaged = dict(state.entities)
    damaged["post"] = damaged["post"].withColumn("title", F.lit("bad")).withColumn("checksum", F.lit("bad"))
    state = ProjectionState(damaged, state.bridge, state.ledger, state.versions)
    same, outcomes = apply_batch(events_frame(spark, feed), state, source, "2024-06-02")
    assert content(same)[1][0] == "bad"
    fixed, outcomes = apply_batch(events_frame(spark, feed[:1]), state, source, "2024-06-02", force=True)
    assert content(fixed)[1][0] == "one"
    assert versions(fixed)[("post", "1")] == 2


def test_split_of_the_feed_does_not_matter(spark):
    rng = random.Random(5)
    feed = make_feed(rng, list(range(1, 13)), 60)
    titles = {a: f"t{a}" for a in range(1, 12)}
    source = source_frame(spark, titles.items(), [(10, "A")], [(a, 10) for a in titles])

    def outcome(batches, **options):
        state = ProjectionState.empty(spark)
        for rows in batches:
            state, _ = apply_batch(events_frame(spark, rows), state, source, "2024-06-01", **options)
            state = ProjectionState(
                {k: spark.createDataFrame(v.collect(), v.schema) for k, v in state.entities.items()},
                *(spark.createDataFrame(x.collect(), x.schema)
                  for x in (state.bridge, state.ledger, state.versions)))
        return state

    whole, halves = outcome([feed]), outcome([feed[:25], feed[25:]])
    assert content(whole) == content(halves) and versions(whole) == versions(halves)
    # Any split at all leaves the same live rows when republished rows are restored.
    mixed = [[e for e in feed if int(e[0][1:]) % 2], [e for e in feed if not int(e[0][1:]) % 2]]

    def live(state):
        return {k for k, v in content(state).items() if v[1] is None}

    assert live(outcome([feed], resurrect=True)) == live(outcome(mixed, resurrect=True))
