"""Registered queries: sources, capture, relay and guards, failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedproj.functions import ids
from feedproj.operators import capture, failures, guards
from feedproj.plans.fixtures import AS_OF, APPLIED_UNTIL, VERB, sha
from feedproj.plans.registry import query
from feedproj.session import shared_dir
from feedproj.sources import feed, state

# --- sources ----------------------------------------------------------------

OUTBOX = f"""
select id, event_type, event_version, aggregate_type, aggregate_id, aggregate_version,
       source_updated_at, checksum, correlation_id, '' as causation_id, payload, created_at,
       case when created_at < timestamp '{APPLIED_UNTIL}' then 'relayed' else 'pending' end as status,
       case when created_at < timestamp '{APPLIED_UNTIL}' then created_at end as relayed_at
from fx_feed"""


def scratch(t, name: str) -> str:
    import uuid

    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("read_outbox", f"select id, aggregate_version, created_at, status from ({OUTBOX}) where status = 'pending'")
def _(t):
    path = scratch(t, "outbox")
    t.sql(OUTBOX).write.parquet(path)
    return feed.read_outbox(t.spark, path).select("id", "aggregate_version", "created_at", "status")


@query("read_events", """select id, aggregate_id, aggregate_version,
       cast(json_extract_string(payload, '$.k') as string) as k from fx_feed""")
def _(t):
    path = scratch(t, "events")
    feed.write_events(t.fx_feed, path)
    return feed.read_events(t.spark, path).select(
        "id", "aggregate_id", "aggregate_version", F.try_element_at("payload_map", F.lit("k")).alias("k"))


META_CTE = """
first_meta as (
  select post_id, meta_key, min(struct_pack(a := meta_id, b := meta_value)).b as v
  from src_meta group by post_id, meta_key),
meta_json as (
  select post_id, '{' || string_agg('"' || replace(meta_key, '/', '\\/') || '":"' || v || '"', ',' order by meta_key)
         || '}' as meta from first_meta group by post_id),
cat_json as (
  select post_id, '[' || string_agg(cast(term_id as string), ',' order by term_id) || ']' as cats
  from (select distinct post_id, term_id from src_post_terms) group by post_id)"""


@query("load_source_state", f""", {META_CTE[1:]}
select p.ID as source_id, post_title as title, coalesce(m.meta, '[]') as meta, coalesce(c.cats, '[]') as categories
from src_posts p left join meta_json m on cast(p.ID as bigint) = m.post_id
left join cat_json c on cast(p.ID as bigint) = c.post_id
where exists (select 1 from fx_feed f where f.aggregate_id = p.ID)""")
def _(t):
    from feedproj.functions.text import canonical_ids_json, canonical_map_json
    from feedproj.operators.canonical import POST

    keys = t.fx_feed.select(F.col("aggregate_id").cast("bigint").alias("_key")).distinct()
    return state.load_source_state(t.source, POST, keys).select(
        F.col("ID").alias("source_id"), F.col("post_title").alias("title"),
        canonical_map_json(F.col("meta")).alias("meta"),
        canonical_ids_json(F.col("category_ids")).alias("categories"))


@query("append_events", f"""select id, aggregate_version from fx_feed
where created_at >= timestamp '{APPLIED_UNTIL}'""")
def _(t):
    stored = t.fx_ledger.select(F.col("event_id").alias("id"))
    return feed.append_events(t.fx_redelivered, stored).select("id", "aggregate_version")


@query("write_dead_letters", """select fx_attempts.event_id, last_error as failure_reason, attempts as attempt_count,
       props as payload_snapshot
from fx_attempts join events on fx_attempts.event_id = concat('ev-', cast(events.event_id as string))
where attempts >= 10""")
def _(t):
    _, dead = failures.split_exhausted(t.fx_attempts)
    path = scratch(t, "dead")
    feed.write_dead_letters(failures.dead_letter_rows(dead, t.fx_feed, AS_OF), path)
    return t.spark.read.parquet(path).select("event_id", "failure_reason", "attempt_count", "payload_snapshot")


# --- capture ----------------------------------------------------------------

STATUSES = """select o_orderkey,
  case o_orderpriority when '1-URGENT' then 'draft' when '2-HIGH' then 'trash' when '3-MEDIUM' then 'private'
       when '5-LOW' then null else 'publish' end as old_status,
  case o_orderstatus when 'F' then 'publish' when 'O' then 'pending' else 'publish' end as new_status
from orders"""


@query("classify_transition", f"""select o_orderkey,
  case when coalesce(old_status, '') <> 'publish' and new_status = 'publish' then 'created'
       when old_status = 'publish' and new_status = 'publish' then 'updated'
       when old_status = 'publish' then 'deleted' end as action
from ({STATUSES})""")
def _(t):
    return t.sql(STATUSES).select(
        "o_orderkey", capture.classify_transition(F.col("old_status"), F.col("new_status")).alias("action"))


def snapshots(d: str) -> tuple[str, str]:
    old = f"""select c_custkey, case c_mktsegment when 'BUILDING' then 'draft' else 'publish' end as status,
      {sha(d, 'c_name')} as checksum from customer where c_nationkey <> 3"""
    new = f"""select c_custkey, case when c_acctbal < 0 then 'draft' else 'publish' end as status,
      {sha(d, "concat(c_name, case c_mktsegment when 'MACHINERY' then '!' else '' end)")} as checksum
      from customer where c_nationkey <> 4"""
    return old, new


DUCK_OLD, DUCK_NEW = snapshots("duckdb")
CHANGES = f"""select * from (
  select concat('content.post.', case
           when n.status = 'publish' and coalesce(o.status, '') <> 'publish' then 'created'
           when n.status = 'publish' and o.checksum <> n.checksum then 'updated'
           when o.status = 'publish' and coalesce(n.status, '') <> 'publish' then 'deleted'
           else 'none' end) as event_type,
         cast(coalesce(o.c_custkey, n.c_custkey) as string) as aggregate_id,
         coalesce(n.status, o.status) as status
  from ({DUCK_OLD}) o full outer join ({DUCK_NEW}) n on o.c_custkey = n.c_custkey)
where event_type <> 'content.post.none'"""


def changes(t):
    old, new = snapshots("spark")
    return capture.derive_changes(t.sql(old), t.sql(new), "c_custkey", "post")


@query("derive_changes", CHANGES)
def _(t):
    return changes(t)


EMITS = """select event_id, concat(cast(user_id as string), cast(date_trunc('hour', ts) as string)) as request_id,
  cast(floor(value / 20) as bigint) as post_id,
  case event_type when 'click' then 'transition' when 'purchase' then 'trash' when 'error' then 'hard_delete'
       else 'save' end as hook
from events"""


@query("collapse_request_emits", f""", emits as ({EMITS})
select event_id, hook from emits e where hook not in ('save', 'trash') or not exists (
  select 1 from emits h where h.hook = 'transition' and h.request_id = e.request_id and h.post_id = e.post_id)""")
def _(t):
    return capture.collapse_request_emits(t.sql(EMITS)).select("event_id", "hook")


SAVES = """select doc_id, case lang when 'en' then 'post' when 'fr' then 'page' else 'attachment' end as post_type,
  case lang when 'de' then 'category' end as taxonomy, n_chars > 2000 as is_revision, n_chars < 100 as is_autosave,
  case source when 'src7' then 'draft' else 'publish' end as post_status
from documents"""


@query("in_scope", f"""select doc_id, post_type from ({SAVES})
where (post_type in ('post', 'page') or taxonomy = 'category')
  and not is_revision and not is_autosave and post_status = 'publish'""")
def _(t):
    return capture.in_scope(t.sql(SAVES), saves=True).select("doc_id", "post_type")


EDITS = f"""select event_id as seq, 'post' as aggregate_type, cast(user_id as string) as aggregate_id,
  concat('content.post.', {VERB}) as event_type, props as payload, ts as created_at from events"""
COUNTERS = """select aggregate_type, aggregate_id, latest_processed_version as current_version from fx_versions"""


def versioned(t, rows: int):
    return capture.assign_versions(t.sql(EDITS), t.sql(COUNTERS), rows=rows)


VERSIONED = f"""select e.*, row_number() over (partition by e.aggregate_id order by created_at, seq)
         + coalesce(c.current_version, 0) as aggregate_version
from ({EDITS}) e left join ({COUNTERS}) c on c.aggregate_id = e.aggregate_id"""


@query("assign_versions", f"select seq, aggregate_id, aggregate_version from ({VERSIONED})")
def _(t):
    return versioned(t, 1_000_000).select("seq", "aggregate_id", "aggregate_version")


@query("assign_versions_hot_keys", f"select seq, aggregate_id, aggregate_version from ({VERSIONED})")
def _(t):
    # The same rows with every larger aggregate treated as hot.
    return versioned(t, 60).select("seq", "aggregate_id", "aggregate_version")


@query("next_counters", f"""select aggregate_type, aggregate_id, max(aggregate_version) as current_version
from ({VERSIONED}) group by aggregate_type, aggregate_id""")
def _(t):
    return capture.next_counters(versioned(t, 1_000_000), t.sql(COUNTERS))


HEX = "strpos('0123456789abcdef', substr(bits, 4, 1))"
UUID7 = f"""substr(ms, 1, 8) || '-' || substr(ms, 9, 4) || '-7' || substr(bits, 1, 3) || '-'
  || substr('89ab89ab89ab89ab', cast({HEX} as bigint), 1) || substr(bits, 5, 3) || '-' || substr(bits, 8, 12)"""


@query("build_envelope", f"""select {UUID7} as id, event_type, 1 as event_version, 'post' as aggregate_type,
  aggregate_id, aggregate_version, timestamp '{AS_OF}' as source_updated_at, sha256(payload) as checksum,
  {UUID7} as correlation_id, cast(null as string) as causation_id, payload,
  date_trunc('second', created_at) as created_at
from (select *, printf('%012x', epoch_us(created_at) // 1000) as ms,
        sha256(concat(event_type, ':', aggregate_id, ':', cast(aggregate_version as string))) as bits
      from ({VERSIONED}))""")
def _(t):
    return capture.build_envelope(versioned(t, 1_000_000), AS_OF)


@query("event_checksum", """select o_orderkey, payload, sha256(payload) as checksum from (
select o_orderkey, '{"post_id":' || cast(o_orderkey as string) || ',"post_type":"post","status":"'
       || o_orderstatus || '"}' as payload from orders)""")
def _(t):
    return t.orders.select(
        "o_orderkey",
        capture.post_payload(F.col("o_orderkey"), F.lit("post"), F.col("o_orderstatus")).alias("payload"),
    ).withColumn("checksum", ids.event_checksum(F.col("payload")))


@query("time_ordered_id", f"""select event_id, {UUID7} as id from (
select event_id, printf('%012x', epoch_us(ts) // 1000) as ms, sha256(cast(event_id as string)) as bits from events)""")
def _(t):
    return t.events.select(
        "event_id", ids.time_ordered_id(F.col("ts").cast("timestamp"), F.col("event_id")).alias("id"))


NAMES = f"""select event_id, case event_type when 'click' then 'page.updated' when 'view' then 'content..post'
  when 'signup' then 'commerce.product.updated' else concat('content.post.', {VERB}) end as event_type from events"""


@query("valid_event_type", f"""select event_id,
  regexp_full_match(event_type, '[^.]+(\\.[^.]+){{2,}}') as valid,
  event_type like 'content.post.%' as registered from ({NAMES})""")
def _(t):
    return t.sql(NAMES).select(
        "event_id", guards.valid_event_type(F.col("event_type")).alias("valid"),
        guards.registered(F.col("event_type")).alias("registered"))


# --- relay, dispatch, guards ------------------------------------------------

@query("relay", f"""select id, event_version, aggregate_version, source_updated_at, causation_id, created_at
from fx_feed where created_at >= timestamp '{APPLIED_UNTIL}'""")
def _(t):
    outbox = t.sql(OUTBOX)
    return guards.relay(outbox.unionByName(outbox), t.sql("select event_id as id from fx_ledger")).select(
        "id", "event_version", "aggregate_version", "source_updated_at", "causation_id", "created_at")


@query("mark_relayed", f"""select id, case when status = 'pending' and event_type like '%.updated' then 'relayed'
    else status end as status,
  case when status = 'pending' and event_type like '%.updated' then timestamp '{AS_OF}' else relayed_at end
    as relayed_at
from ({OUTBOX})""")
def _(t):
    done = t.fx_feed.where("event_type like '%.updated'").select("id")
    return guards.mark_relayed(t.sql(OUTBOX), done, AS_OF).select("id", "status", "relayed_at")


@query("undispatched", "select id from fx_feed where id not in (select event_id from fx_ledger)")
def _(t):
    return guards.undispatched(t.fx_feed, t.fx_ledger).select("id")


@query("oldest_first", "select id, created_at from fx_feed order by created_at, id limit 100")
def _(t):
    return guards.oldest_first(t.fx_feed, 100).select("id", "created_at")


@query("route", f"""select event_id, split_part(event_type, '.', 1) as queue_name from ({NAMES})
where split_part(event_type, '.', 1) in ('content', 'commerce', 'system')""")
def _(t):
    routed, _ = guards.route(t.sql(NAMES))
    return routed.select("event_id", "queue_name")


@query("route_unknown", f"select event_id, event_type from ({NAMES}) where event_type like 'page.%'")
def _(t):
    _, unknown = guards.route(t.sql(NAMES))
    return unknown.select("event_id", "event_type")


@query("dedup_exact", f"""select id, aggregate_id, aggregate_version from fx_feed
where created_at >= timestamp '{APPLIED_UNTIL}'""")
def _(t):
    return guards.dedup_exact(t.fx_redelivered, t.fx_ledger).select("id", "aggregate_id", "aggregate_version")


FRESH = """select f.* from fx_feed f left join fx_versions v on f.aggregate_id = v.aggregate_id
where v.aggregate_id is null or f.aggregate_version > v.latest_processed_version"""


@query("stale_guard_fresh", f"select id, aggregate_version from ({FRESH})")
def _(t):
    fresh, _ = guards.stale_guard(t.fx_feed, t.fx_versions)
    return fresh.select("id", "aggregate_version")


@query("stale_guard_stale", """select id, f.aggregate_version from fx_feed f join fx_versions v
on f.aggregate_id = v.aggregate_id where f.aggregate_version <= v.latest_processed_version""")
def _(t):
    # Salted: every larger aggregate is treated as hot.
    _, stale = guards.stale_guard(t.fx_feed, t.fx_versions, rows=60)
    return stale.select("id", "aggregate_version")


@query("reduce_aggregates", f"""select aggregate_type, aggregate_id,
  min(aggregate_version) filter (where event_type not like '%.deleted') as min_u,
  max(aggregate_version) filter (where event_type not like '%.deleted') as max_u,
  max(aggregate_version) filter (where event_type like '%.deleted') as max_d,
  arg_max(source_updated_at, aggregate_version) filter (where event_type like '%.deleted') as t_d,
  count(*) as n_events
from ({FRESH}) group by aggregate_type, aggregate_id""")
def _(t):
    fresh, _ = guards.stale_guard(t.fx_feed, t.fx_versions)
    return guards.reduce_aggregates(fresh)


@query("latest_per_aggregate", """select aggregate_id, id, event_type, aggregate_version from fx_feed
qualify row_number() over (partition by aggregate_id order by aggregate_version desc, id desc) = 1""")
def _(t):
    return guards.latest_per_aggregate(t.fx_redelivered).select(
        "aggregate_id", "id", "event_type", "aggregate_version")


@query("split_actions", """select id, case when event_type like '%.deleted' then 'tombstone' else 'upsert' end as side
from fx_feed""")
def _(t):
    up, down = guards.split_actions(t.fx_feed)
    return up.select("id", F.lit("upsert").alias("side")).union(down.select("id", F.lit("tombstone").alias("side")))


@query("reject_unregistered", f"""select event_id, event_type, 'unregistered' as failure_reason from ({NAMES})
where event_type not like 'content.post.%'""")
def _(t):
    _, failed = guards.reject_unregistered(t.sql(NAMES))
    return failed.select("event_id", "event_type", "failure_reason")


@query("reject_orphans", """select id, aggregate_id, 'orphan' as failure_reason from fx_feed f
where event_type not like '%.deleted'
  and not exists (select 1 from supplier where cast(s_suppkey as string) = f.aggregate_id)""")
def _(t):
    up, _ = guards.split_actions(t.fx_feed)
    _, lost = guards.reject_orphans(up, t.supplier.select(F.col("s_suppkey").alias("source_key")), "source_key")
    return lost.select("id", "aggregate_id", "failure_reason")


@query("reject_missing_event", f"""select a.event_id, 'missing_event' as failure_reason from fx_attempts a
where a.event_id not in (select event_id from fx_ledger)""")
def _(t):
    stored = t.fx_ledger.select(F.col("event_id").alias("id"))
    return guards.reject_missing_event(t.fx_attempts, stored).select("event_id", "failure_reason")


# --- failures ---------------------------------------------------------------

BACKOFF = "case when attempts <= 0 then 0 else cast(least(3600, 30 * power(2, least(attempts, 20) - 1)) as int) end"


@query("backoff_seconds", f"""select event_id, attempts, {BACKOFF} as base_seconds, true as jitter_in_range
from fx_attempts""")
def _(t):
    base = failures.backoff_base(F.col("attempts"))
    extra = failures.backoff_seconds(F.col("attempts"), F.col("event_id")) - base
    return t.fx_attempts.select(
        "event_id", "attempts", base.alias("base_seconds"),
        ((extra >= 0) & (extra <= F.floor(base / 4))).alias("jitter_in_range"))


FAILED = """select id as event_id, 'content' as queue_name, 'orphan' as failure_reason from fx_feed
where event_type like '%.created'"""


@query("schedule_retry", f"""select f.event_id, f.queue_name, coalesce(a.attempts, 0) + 1 as attempts,
  true as due_in_range, f.failure_reason as last_error
from ({FAILED}) f left join fx_attempts a on a.event_id = f.event_id""")
def _(t):
    base = failures.backoff_base(F.col("attempts"))
    wait = F.unix_seconds("available_at") - F.unix_seconds(F.lit(AS_OF).cast("timestamp"))
    return failures.schedule_retry(t.sql(FAILED), t.fx_attempts, AS_OF).select(
        "event_id", "queue_name", "attempts",
        ((wait >= base) & (wait <= base + F.floor(base / 4))).alias("due_in_range"), "last_error")


@query("split_exhausted", """select event_id, case when attempts >= 10 then 'dead' else 'retry' end as side
from fx_attempts""")
def _(t):
    retry, dead = failures.split_exhausted(t.fx_attempts)
    return retry.select("event_id", F.lit("retry").alias("side")).union(
        dead.select("event_id", F.lit("dead").alias("side")))


@query("eligible", f"""select event_id, available_at from fx_attempts
where queue_name = 'content' and available_at <= timestamp '{APPLIED_UNTIL}'""")
def _(t):
    return failures.eligible(t.fx_attempts, APPLIED_UNTIL, "content").select("event_id", "available_at")


@query("expired", f"""select event_id,
  case when late then timestamp '{APPLIED_UNTIL}' else available_at end as available_at,
  case when late then null else deadline end as deadline
from (select *, queue_name = 'content' and coalesce(deadline < timestamp '{APPLIED_UNTIL}', false) as late
      from fx_attempts)""")
def _(t):
    return failures.expired(t.fx_attempts, APPLIED_UNTIL, "content").select(
        "event_id", "available_at", "deadline")


@query("dead_letter_rows", """select a.event_id, a.last_error as failure_reason, a.attempts as attempt_count,
  coalesce(f.payload, '{"raw":"null"}') as payload_snapshot
from fx_attempts a left join fx_feed f on f.id = a.event_id and f.event_type not like '%.created'
where a.attempts >= 10""")
def _(t):
    _, dead = failures.split_exhausted(t.fx_attempts)
    known = t.fx_feed.where("event_type not like '%.created'")
    return failures.dead_letter_rows(dead, known, AS_OF).select(
        "event_id", "failure_reason", "attempt_count", "payload_snapshot")


@query("coerce_snapshot", """select doc_id, '{"raw":' || cast(to_json(text) as string) || '}' as snapshot from documents
where text is not null""")
def _(t):
    from feedproj.functions.text import coerce_snapshot

    return t.documents.select("doc_id", coerce_snapshot(F.col("text")).alias("snapshot"))


@query("redrive", """select id, aggregate_version from fx_feed
where id in (select event_id from fx_attempts where attempts >= 10)""")
def _(t):
    _, dead = failures.split_exhausted(t.fx_attempts)
    return failures.redrive(dead, t.fx_feed).select("id", "aggregate_version")
