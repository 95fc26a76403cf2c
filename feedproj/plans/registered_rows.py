"""Registered queries: validation, canonical rows, projection apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedproj.functions import text, times
from feedproj.functions.ids import surrogate_id
from feedproj.operators import canonical as C
from feedproj.operators import projection
from feedproj.plans.apply import ProjectionState, apply_batch
from feedproj.plans.fixtures import AS_OF, sid
from feedproj.plans.registered_feed import META_CTE
from feedproj.plans.registry import query
from feedproj.session import checkpointed
from feedproj.sources.state import load_source_state, meta_maps

# --- SQL for canonical rows -------------------------------------------------

UNSET = "{0} is null or {0} = '' or {0} = '0000-00-00 00:00:00'"
STAMP = "'%Y-%m-%d %H:%M:%S'"


def gmt(col: str) -> str:
    """Source date text to a UTC timestamp."""
    zoned = f"try_strptime(substr({col}, 1, 19), '%Y-%m-%dT%H:%M:%S') - interval 2 hour"
    return (f"case when {UNSET.format(col)} then timestamp '{AS_OF}' "
            f"when {col} like '%+02:00' then {zoned} else try_strptime({col}, {STAMP}) end")


POST_VIOLATIONS = f"""
  case when not coalesce(try_cast(ID as bigint) > 0, false) then
         case when trim(post_name) = '' then 'number:ID,text:post_name' else 'number:ID' end
       when trim(post_name) = '' then 'text:post_name'
       when {gmt('post_modified_gmt')} is null then 'date:post_modified_gmt'
       else '' end"""


def atom(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S+00:00')"


# Typed posts of the current source with JSON of meta and categories, all rows.
POSTS_NOW = f"""
{META_CTE[1:]},
typed_posts as (
  select cast(ID as bigint) as post_id, trim(post_title) as title, post_content as content,
         coalesce(post_excerpt, '') as excerpt, post_name as slug, post_status as status,
         coalesce(post_author_login, post_author, '') as author,
         {gmt('post_date_gmt')} as published_at, {gmt('post_modified_gmt')} as modified_at,
         coalesce(c.cats, '[]') as cats, coalesce(m.meta, '[]') as meta, {POST_VIOLATIONS} as violations
  from src_posts p left join meta_json m on cast(p.ID as bigint) = m.post_id
  left join cat_json c on cast(p.ID as bigint) = c.post_id),
canonical_posts as (
  select *, sha256(concat_ws(chr(0), cast(post_id as string), title, content, excerpt, slug, status, author,
    {atom('published_at')}, {atom('modified_at')}, cats, meta)) as checksum
  from typed_posts where violations = '')"""
# Posts and pages share one id space, so the meta table serves both.
PAGES_NOW = f"""
{META_CTE[1:]},
typed_pages as (
  select cast(ID as bigint) as post_id, trim(post_title) as title, post_content as content, post_name as slug,
         post_status as status, coalesce(cast(post_parent as bigint), 0) as parent_id,
         cast(menu_order as int) as menu_order, cast(post_date_gmt as timestamp) as published_at,
         cast(post_modified_gmt as timestamp) as modified_at, coalesce(m.meta, '[]') as meta
  from src_pages p left join meta_json m on cast(p.ID as bigint) = m.post_id),
canonical_pages as (
  select *, sha256(concat_ws(chr(0), cast(post_id as string), title, content, slug, status,
    cast(parent_id as string), cast(menu_order as string), {atom('published_at')}, {atom('modified_at')}, meta))
    as checksum
  from typed_pages where post_id > 0)"""
TERMS_NOW = """
canonical_terms as (
  select *, sha256(concat_ws(chr(0), cast(term_id as string), name, slug, description,
    cast(parent_id as string), cast(post_count as string))) as checksum
  from (select cast(term_id as bigint) as term_id, trim(name) as name, slug, coalesce(description, '') as description,
               coalesce(cast(parent as bigint), 0) as parent_id, cast(count as int) as post_count
        from src_terms) where term_id > 0)"""


def canonical(t, spec, keys=None):
    return C.canonical_rows(load_source_state(t.source, spec, keys), spec, AS_OF)


# --- validation and canonical rows ------------------------------------------

@query("validate_posts", f""", {POSTS_NOW} select post_id, violations from typed_posts where violations <> ''""")
def _(t):
    _, bad = C.validate(t.src_posts, C.POST)
    return bad.select(
        F.col("ID").cast("bigint").alias("post_id"), F.concat_ws(",", "violations").alias("violations"))


@query("validate_categories", """select term_id, 'number:term_id' as violations from src_terms where term_id = '0'""")
def _(t):
    _, bad = C.validate(t.src_terms, C.CATEGORY)
    return bad.select("term_id", F.concat_ws(",", "violations").alias("violations"))


@query("date_rule", f"""select ID, post_modified_gmt <> 'soon' as acceptable,
  {gmt('post_modified_gmt')} as modified_at, {gmt('post_date_gmt')} as published_at from src_posts""")
def _(t):
    return t.src_posts.select(
        "ID", times.date_is_acceptable(F.col("post_modified_gmt")).alias("acceptable"),
        times.parse_gmt(F.col("post_modified_gmt"), AS_OF).alias("modified_at"),
        times.parse_gmt(F.col("post_date_gmt"), AS_OF).alias("published_at"))


@query("extract_posts", f""", {POSTS_NOW} select post_id, content, excerpt, slug, author, published_at, modified_at, cats
from typed_posts where violations = ''""")
def _(t):
    good, _ = C.validate(load_source_state(t.source, C.POST), C.POST)
    return C.extract(good, C.POST, AS_OF).select(
        "post_id", "content", "excerpt", "slug", "author", "published_at", "modified_at",
        text.canonical_ids_json(F.col("category_ids")).alias("cats"))


@query("extract_pages", f""", {PAGES_NOW} select post_id, parent_id, menu_order, slug, published_at from typed_pages
where post_id > 0""")
def _(t):
    good, _ = C.validate(load_source_state(t.source, C.PAGE), C.PAGE)
    return C.extract(good, C.PAGE, AS_OF).select("post_id", "parent_id", "menu_order", "slug", "published_at")


@query("extract_categories", f""", {TERMS_NOW} select term_id, name, slug, description, parent_id, post_count
from canonical_terms""")
def _(t):
    return canonical(t, C.CATEGORY).drop("checksum")


@query("normalise_meta", """select post_id, meta_key, min(struct_pack(a := meta_id, b := meta_value)).b as meta_value
from src_meta group by post_id, meta_key""")
def _(t):
    return meta_maps(t.src_meta).select("post_id", F.explode("meta").alias("meta_key", "meta_value"))


@query("normalise_ids", "select event_id, coalesce(try_cast(event_type as bigint), 0) + user_id as ids from events")
def _(t):
    both = F.array("event_type", F.col("user_id").cast("string"))
    return t.events.select("event_id", F.aggregate(
        text.id_list(both), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("ids"))


@query("canonical_json", f""", {META_CTE[1:]} select post_id, meta from meta_json""")
def _(t):
    return meta_maps(t.src_meta).select("post_id", text.canonical_map_json(F.col("meta")).alias("meta"))


@query("post_checksum", f""", {POSTS_NOW} select post_id, title, checksum from canonical_posts""")
def _(t):
    return canonical(t, C.POST).select("post_id", "title", "checksum")


@query("page_checksum", f""", {PAGES_NOW} select post_id, title, checksum from canonical_pages""")
def _(t):
    return canonical(t, C.PAGE).select("post_id", "title", "checksum")


@query("category_checksum", f""", {TERMS_NOW} select term_id, name, checksum from canonical_terms""")
def _(t):
    return canonical(t, C.CATEGORY).select("term_id", "name", "checksum")


# --- stored state before a batch --------------------------------------------

EARLIER = "2023-12-01 00:00:00"
# Posts projected earlier: some unchanged since, some with older content, some deleted.
STORED = f"""
stored_posts as (
  select {sid('duckdb', 'post', 'post_id')} as id, post_id as source_post_id, 'post' as source_entity_type,
         slug, case excerpt when 'done' then title else 'older' end as title, content, excerpt, status, author,
         published_at, modified_at as updated_at,
         case when title = '4-NOT SPECIFIED' then timestamp '{EARLIER}' end as deleted_at,
         case excerpt when 'done' then checksum else 'older' end as checksum,
         meta as meta_jsonb, timestamp '{EARLIER}' as created_at, timestamp '{EARLIER}' as synced_at
  from canonical_posts where status = 'publish')"""


def stored_posts(t):
    keep = F.col("excerpt") == "done"
    return (
        canonical(t, C.POST).where("status = 'publish'")
        .select(*[c.alias(n) for n, c in projection.projected_columns(C.POST, EARLIER).items()])
        .withColumn("deleted_at", F.when(F.col("title") == "4-NOT SPECIFIED", times.instant(EARLIER)))
        .withColumn("title", F.when(keep, F.col("title")).otherwise("older"))
        .withColumn("checksum", F.when(keep, F.col("checksum")).otherwise("older"))
    )


@query("suppress", f""", {POSTS_NOW}, {STORED}
select post_id, coalesce(c.checksum = s.checksum, false) as suppressed
from canonical_posts c left join stored_posts s on s.source_post_id = c.post_id""")
def _(t):
    return projection.suppress(canonical(t, C.POST), stored_posts(t), C.POST).select("post_id", "suppressed")


@query("version_guard", """select id, coalesce(aggregate_version < latest_processed_version, false) as outdated
from fx_feed f left join fx_versions v on f.aggregate_id = v.aggregate_id""")
def _(t):
    return projection.version_guard(t.fx_feed, t.fx_versions).select("id", "outdated")


@query("upsert_posts", f""", {POSTS_NOW}, {STORED}
select {sid('duckdb', 'post', 'post_id')} as id, post_id as source_post_id, c.title, c.checksum,
  cast(null as timestamp) as deleted_at, c.meta as meta_jsonb,
  coalesce(s.created_at, timestamp '{AS_OF}') as created_at, timestamp '{AS_OF}' as synced_at
from canonical_posts c left join stored_posts s on s.source_post_id = c.post_id""")
def _(t):
    return projection.upsert_rows(stored_posts(t), canonical(t, C.POST), C.POST, AS_OF).select(
        "id", "source_post_id", "title", "checksum", "deleted_at", "meta_jsonb", "created_at", "synced_at")


@query("upsert_pages", f""", {PAGES_NOW}
select {sid('duckdb', 'page', 'post_id')} as id, post_id as source_post_id, title, slug, parent_id, menu_order,
  published_at, modified_at as updated_at, checksum, case when status = 'publish' then timestamp '{EARLIER}'
  else timestamp '{AS_OF}' end as created_at
from canonical_pages""")
def _(t):
    rows = canonical(t, C.PAGE)
    older = rows.where("status = 'publish'").select(
        *[c.alias(n) for n, c in projection.projected_columns(C.PAGE, EARLIER).items()])
    return projection.upsert_rows(older.withColumn("title", F.lit("older")), rows, C.PAGE, AS_OF).select(
        "id", "source_post_id", "title", "slug", "parent_id", "menu_order", "published_at", "updated_at",
        "checksum", "created_at")


@query("upsert_taxonomies", f""", {TERMS_NOW}
select {sid('duckdb', 'category', 'term_id')} as id, term_id as source_term_id, 'category' as taxonomy_type, slug,
  name, description, parent_id, post_count, checksum, timestamp '{AS_OF}' as updated_at
from canonical_terms""")
def _(t):
    rows = canonical(t, C.CATEGORY)
    older = rows.where("parent_id <> 2").select(
        *[c.alias(n) for n, c in projection.projected_columns(C.CATEGORY, EARLIER).items()])
    return projection.upsert_rows(older, rows, C.CATEGORY, AS_OF).select(
        "id", "source_term_id", "taxonomy_type", "slug", "name", "description", "parent_id", "post_count",
        "checksum", "updated_at")


@query("tombstone", f""", {POSTS_NOW}, {STORED}, gone as (
  select aggregate_id, max(source_updated_at) as gone_at from fx_feed where event_type like '%.deleted'
  group by aggregate_id)
select source_post_id, title, checksum, coalesce(gone_at, deleted_at) as deleted_at, synced_at
from stored_posts left join gone on cast(source_post_id as string) = aggregate_id""")
def _(t):
    deletes = t.fx_feed.where("event_type like '%.deleted'").select(
        F.col("aggregate_id").cast("bigint").alias("source_post_id"), "source_updated_at")
    return projection.tombstone(stored_posts(t), deletes, C.POST).select(
        "source_post_id", "title", "checksum", "deleted_at", "synced_at")


TOUCHED = "select distinct cast(user_id as bigint) as post_id from events"


@query("rewrite_bridge", f""", touched as (select {sid('duckdb', 'post', 'post_id')} as id, post_id from ({TOUCHED})),
known as (select * from fx_taxonomies where parent_id <> 2)
select entity_id, taxonomy_id from fx_bridge where entity_id not in (select id from touched)
union all
select distinct touched.id as entity_id, known.id as taxonomy_id
from touched join src_post_terms s on s.post_id = touched.post_id join known on known.source_term_id = s.term_id""")
def _(t):
    from feedproj.sources.state import category_lists

    touched = t.sql(TOUCHED)
    lists = category_lists(t.src_post_terms.join(touched, "post_id", "left_semi"))
    written = touched.join(lists, "post_id", "left").select(
        surrogate_id("post", F.col("post_id")).alias("id"), "category_ids")
    return projection.rewrite_bridge(t.fx_bridge, written, t.fx_taxonomies.where("parent_id <> 2"))


@query("append_ledger", f"""select id as event_id, checksum,
  case when created_at < timestamp '2024-01-15 00:00:00' then created_at else timestamp '{AS_OF}' end as processed_at
from fx_feed""")
def _(t):
    return projection.append_ledger(t.fx_ledger, t.fx_redelivered, AS_OF)


@query("advance_versions", f"""select aggregate_type, aggregate_id, max(aggregate_version) as latest_processed_version,
  timestamp '{AS_OF}' as latest_processed_at from fx_feed group by aggregate_type, aggregate_id""")
def _(t):
    return projection.advance_versions(t.fx_versions, t.fx_redelivered, AS_OF)


@query("surrogate_id", f"select o_orderkey, {sid('duckdb', 'post', 'o_orderkey')} as id from orders")
def _(t):
    return t.orders.select("o_orderkey", surrogate_id("post", F.col("o_orderkey")).alias("id"))


# --- the whole batch --------------------------------------------------------

def applied(t, resurrect: bool = False):
    """The redelivered feed against the stored posts, half of it applied already."""
    state = ProjectionState.empty(t.spark)
    entities = dict(state.entities)
    entities["post"] = stored_posts(t)
    entities["category"] = t.sql(f"""select id, source_term_id, taxonomy_type, slug, name, '' as description,
        cast(parent_id as bigint) as parent_id, post_count, deleted_at, 'x' as checksum,
        timestamp '{EARLIER}' as created_at, timestamp '{EARLIER}' as updated_at,
        timestamp '{EARLIER}' as synced_at from fx_taxonomies""")
    state = ProjectionState(entities, t.fx_bridge, t.fx_ledger, t.fx_versions)
    return apply_batch(t.fx_redelivered, state, t.source, AS_OF, resurrect=resurrect, stage=checkpointed)


# The closed form over the same tables, written once for all outcome queries.
APPLY = f"""{POSTS_NOW}, {STORED},
fresh as (
  select f.*, cast(aggregate_id as bigint) as post_id, event_type like '%.deleted' as is_down
  from fx_feed f left join fx_versions v using (aggregate_type, aggregate_id)
  where v.latest_processed_version is null or f.aggregate_version > v.latest_processed_version),
source_ok as (
  select cast(ID as bigint) as post_id, violations = '' as ok from typed_posts join src_posts
  on typed_posts.post_id = cast(src_posts.ID as bigint)),
reduced as (
  select aggregate_id, f.post_id, any_value(ok) as ok,
    min(aggregate_version) filter (where not is_down and ok) as min_u,
    max(aggregate_version) filter (where not is_down and ok) as max_u,
    max(aggregate_version) filter (where is_down) as max_d,
    arg_max(source_updated_at, aggregate_version) filter (where is_down) as t_d
  from fresh f left join source_ok s on s.post_id = f.post_id group by aggregate_id, f.post_id),
decided as (
  select r.*, s.id is not null as had, coalesce(s.checksum = c.checksum, false) as same,
    s.title as old_title, s.checksum as old_checksum, s.deleted_at as old_deleted, s.synced_at as old_synced,
    s.created_at as old_created, c.title as new_title, c.checksum as new_checksum
  from reduced r left join stored_posts s on s.source_post_id = r.post_id
  left join canonical_posts c on c.post_id = r.post_id),
result as (
  select *, max_u is not null and not same as wrote,
    case when max_d is not null and (max_u is null or max_d > max_u) then t_d
         when max_u is null then old_deleted
         when max_d is not null then case when min_u < max_d or same then t_d end
         when same then old_deleted end as gone_at
  from decided)"""


# Columns of a post's row that a write takes from the canonical row, by their names there.
CARRIED = {
    "slug": "slug", "title": "title", "content": "content", "excerpt": "excerpt", "status": "status", "author": "author",
    "published_at": "published_at", "updated_at": "modified_at", "checksum": "checksum", "meta_jsonb": "meta",
}


@query("apply_batch_posts", f""", {APPLY}
select {sid('duckdb', 'post', 'r.post_id')} as id, r.post_id as source_post_id, 'post' as source_entity_type,
  {', '.join(f"case when wrote then c.{new} else s.{old} end as {old}" for old, new in CARRIED.items())},
  gone_at as deleted_at, coalesce(old_created, timestamp '{AS_OF}') as created_at,
  case when wrote then timestamp '{AS_OF}' else old_synced end as synced_at
from result r left join canonical_posts c on c.post_id = r.post_id left join stored_posts s on s.source_post_id = r.post_id
where had or max_u is not null
union all
select id, source_post_id, source_entity_type, {', '.join(CARRIED)}, deleted_at, created_at, synced_at from stored_posts
where source_post_id not in (select post_id from result)""")
def _(t):
    state, _ = applied(t)
    return state.entities["post"]


@query("apply_batch_outcomes", f""", {APPLY}
select f.id, f.aggregate_version, cast(2 as bigint) as deliveries,
  case when v.latest_processed_version >= f.aggregate_version then 'stale'
       when f.event_type like '%.deleted' then
         case when f.aggregate_version = r.max_d and r.gone_at is not distinct from r.t_d then 'applied'
              when f.aggregate_version = r.max_d and not r.had and r.max_u is null then 'applied'
              else 'superseded' end
       when r.ok is null then case when r.max_d > f.aggregate_version then 'superseded' else 'orphan' end
       when not r.ok then case when r.max_d > f.aggregate_version then 'superseded' else 'rejected' end
       when f.aggregate_version = r.max_u then case when r.wrote then 'applied' else 'suppressed_checksum' end
       else 'superseded' end as outcome
from fx_feed f left join fx_versions v using (aggregate_type, aggregate_id)
left join result r on r.aggregate_id = f.aggregate_id""")
def _(t):
    _, outcomes = applied(t)
    return outcomes.select("id", "aggregate_version", "deliveries", "outcome")


@query("apply_batch_versions", f""", {APPLY}
select v.aggregate_type, v.aggregate_id,
  greatest(v.latest_processed_version, coalesce(r.max_u, 0), coalesce(r.max_d, 0)) as latest_processed_version
from fx_versions v left join result r using (aggregate_id)
union all
select 'post', aggregate_id, greatest(coalesce(max_u, 0), coalesce(max_d, 0)) from result
where aggregate_id not in (select aggregate_id from fx_versions) and (max_u is not null or max_d is not null)""")
def _(t):
    state, _ = applied(t)
    return state.versions.select("aggregate_type", "aggregate_id", "latest_processed_version")


@query("apply_batch_bridge", f""", {APPLY},
written as (select {sid('duckdb', 'post', 'post_id')} as id, post_id from result where wrote)
select entity_id, taxonomy_id from fx_bridge where entity_id not in (select id from written)
union all
select distinct w.id, x.id from written w join src_post_terms s on s.post_id = w.post_id
join fx_taxonomies x on x.source_term_id = s.term_id""")
def _(t):
    state, _ = applied(t)
    return state.bridge


@query("apply_batch_ledger", f""", {APPLY}
select event_id from fx_ledger
union
select f.id from fresh f join result r using (aggregate_id) where f.is_down or r.ok""")
def _(t):
    state, _ = applied(t)
    return state.ledger.select("event_id")
