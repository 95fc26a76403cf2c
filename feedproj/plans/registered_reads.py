"""Registered queries: listings, lookups, page numbering, response shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedproj.functions import cursor, shape, text, times
from feedproj.operators import listing
from feedproj.plans.fixtures import AS_OF
from feedproj.plans.registry import query
from feedproj.sources import feed

SLUG = "nation-13"
AFTER = "1995-03-01 00:00:00"

VISIBLE = "deleted_at is null and status = 'publish'"
MEMBERS = f"""select entity_id from fx_bridge b join fx_taxonomies x on x.id = b.taxonomy_id
where x.slug = '{SLUG}' and x.deleted_at is null"""
IN_CATEGORY = f"select * from fx_posts where {VISIBLE} and id in ({MEMBERS})"


def base64url(sort: str) -> str:
    body = f"""'{{"s":"' || {sort} || '","id":"' || id || '"}}'"""
    return f"rtrim(replace(replace(to_base64(encode({body})), '+', '-'), '/', '_'), '=')"


STAMP = "strftime(published_at, '%Y-%m-%d %H:%M:%S')"


# --- listings ---------------------------------------------------------------

@query("list_pages", f"""select slug, published_at from fx_pages where {VISIBLE}
order by published_at desc, id desc limit 20""")
def _(t):
    return listing.list_pages(t.fx_pages).rows.select("slug", "published_at")


@query("list_posts", f"""select slug, published_at from fx_posts where {VISIBLE}
order by published_at desc, id desc limit 100""")
def _(t):
    return listing.list_posts(t.fx_posts, limit=500).rows.select("slug", "published_at")


@query("list_posts_in_category", f"""select slug, published_at from ({IN_CATEGORY})
where published_at > timestamp '{AFTER}' order by published_at desc, id desc limit 20""")
def _(t):
    page = listing.list_posts(t.fx_posts, t.fx_bridge, t.fx_taxonomies, published_after=AFTER, category_slug=SLUG)
    return page.rows.select("slug", "published_at")


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S+00:00')"
SHAPED_POST = f"""slug, title, content, coalesce(excerpt, '') as excerpt, status, author,
  {ISO.format('published_at')} as published_at, {ISO.format('updated_at')} as updated_at"""


@query("list_posts_second_page", f"""select {SHAPED_POST} from (
select * from ({IN_CATEGORY}) where published_at > timestamp '{AFTER}'
order by published_at desc, id desc limit 20 offset 20)""")
def _(t):
    args = dict(published_after=AFTER, category_slug=SLUG)
    first = listing.list_posts(t.fx_posts, t.fx_bridge, t.fx_taxonomies, **args)
    # Reads one page (21 rows) to learn where the second starts.
    second = listing.list_posts(
        t.fx_posts, t.fx_bridge, t.fx_taxonomies, cursor=first.next_cursor(), **args)
    return shape.shape_post(second.rows).drop("meta")


@query("list_categories", """select slug, name from fx_taxonomies where deleted_at is null
and taxonomy_type = 'category' order by name, id limit 50""")
def _(t):
    return listing.list_categories(t.fx_taxonomies).rows.select("slug", "name")


@query("list_categories_after", """select slug, name from fx_taxonomies where deleted_at is null
and name > 'NATION_15' order by name, id limit 7""")
def _(t):
    last = t.fx_taxonomies.where("name = 'NATION_15'").select(
        cursor.encode_cursor(F.col("name"), F.col("id")).alias("c")).first()["c"]
    return listing.list_categories(t.fx_taxonomies, cursor=last, limit=7).rows.select("slug", "name")


@query("updated_after", f"""select slug, updated_at from fx_posts where {VISIBLE}
and updated_at > timestamp '1999-06-01 00:00:00' order by published_at desc, id desc limit 50""")
def _(t):
    return listing.list_posts(t.fx_posts, updated_after="1999-06-01 00:00:00", limit=50).rows.select(
        "slug", "updated_at")


@query("visible", f"select source_post_id, status from fx_posts where {VISIBLE}")
def _(t):
    return listing.visible(t.fx_posts).select("source_post_id", "status")


@query("in_category", f"select slug from fx_posts where id in ({MEMBERS})")
def _(t):
    return listing.in_category(t.fx_posts, t.fx_bridge, t.fx_taxonomies, SLUG).select("slug")


@query("keyset_seek", f"""select slug from fx_posts where {VISIBLE} and (published_at < timestamp '{AFTER}'
or (published_at = timestamp '{AFTER}' and id < '8'))""")
def _(t):
    rows = listing.visible(t.fx_posts)
    return rows.where(listing.seek_before("published_at", times.instant(AFTER), "8")).select("slug")


@query("look_ahead", f"""select slug, true as has_more,
  case when row_number() over (order by published_at, id) = 1 then {base64url(STAMP)} end as next_cursor
from (select * from fx_posts where {VISIBLE} order by published_at desc, id desc limit 20)""")
def _(t):
    page = listing.list_posts(t.fx_posts)
    return listing.page_rows(page.look_ahead, page.limit, listing.newest_first()).select(
        "slug", "has_more", "next_cursor")


@query("encode_cursor", f"select source_post_id, {base64url(STAMP)} as token from fx_posts")
def _(t):
    return t.fx_posts.select(
        "source_post_id", cursor.encode_cursor(F.col("published_at"), F.col("id")).alias("token"))


@query("decode_cursor", f"select source_post_id, {STAMP} as s, id from fx_posts")
def _(t):
    token = cursor.encode_cursor(F.col("published_at"), F.col("id"))
    return t.fx_posts.select("source_post_id", cursor.decode_cursor(token).alias("c")).select(
        "source_post_id", "c.s", "c.id")


for _kind, _table, _slug, _where in (
    ("page", "fx_pages", "part-5", VISIBLE),
    ("post", "fx_posts", "order-32", VISIBLE),
    ("category", "fx_taxonomies", "nation-7", "deleted_at is null"),
):
    def _find(t, table=_table, slug=_slug):
        return listing.find_by_slug(getattr(t, table), slug).select("id", "slug")

    query(f"find_{_kind}_by_slug", f"select id, slug from {_table} where slug = '{_slug}' and {_where}")(_find)


def clustered(t):
    """Posts and links laid out for listings and lookups."""
    from feedproj.plans.registered_feed import scratch
    from feedproj.sources.layout import write_clustered

    posts, bridge = scratch(t, "posts"), scratch(t, "bridge")
    write_clustered(t.fx_posts, posts, ["published_at", "updated_at"], {"slug": 100_000, "id": 100_000})
    write_clustered(t.fx_bridge, bridge, ["taxonomy_id", "entity_id"], {"taxonomy_id": 1000})
    return t.spark.read.parquet(posts), t.spark.read.parquet(bridge)


@query("find_post_by_slug_clustered", f"select id, slug from fx_posts where slug = 'order-32' and {VISIBLE}")
def _(t):
    return listing.find_by_slug(clustered(t)[0], "order-32").select("id", "slug")


@query("list_posts_in_category_clustered", f"""select slug, published_at from ({IN_CATEGORY})
where published_at > timestamp '{AFTER}' order by published_at desc, id desc limit 20""")
def _(t):
    posts, bridge = clustered(t)
    return listing.list_posts(posts, bridge, t.fx_taxonomies, published_after=AFTER, category_slug=SLUG).rows.select(
        "slug", "published_at")


@query("find_posts_by_slugs", f"""select slug, id, title from fx_posts where {VISIBLE}
and slug in (select concat('order-', cast(l_orderkey as string)) from lineitem where l_quantity > 49)""")
def _(t):
    wanted = t.lineitem.where("l_quantity > 49").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("slug"))
    return listing.find_by_slugs(t.fx_posts, wanted).select("slug", "id", "title")


@query("paginate_all", f"""select slug, cast(floor(n / 20) + 1 as bigint) as page,
  case when (n + 1) % 20 = 0 and n + 1 < total then {base64url(STAMP)} end as next_cursor
from (select *, row_number() over (order by published_at desc, id desc) - 1 as n, count(*) over () as total
      from fx_posts where {VISIBLE})""")
def _(t):
    rows = listing.visible(t.fx_posts).select("slug", "published_at", "id")
    return listing.paginate_all(rows, 20, listing.newest_first(), "published_at").select(
        "slug", "page", "next_cursor")


# --- shapes -----------------------------------------------------------------

@query("shape_post", f"select {SHAPED_POST}, substr(meta_jsonb, 7, 1) as meta_k from fx_posts")
def _(t):
    return shape.shape_post(t.fx_posts).select("*", F.col("meta")["k"].alias("meta_k")).drop("meta")


@query("shape_page", f"""select slug, title, content, status, coalesce(parent_id, 0) as parent_id, menu_order,
  {ISO.format('published_at')} as published_at, {ISO.format('updated_at')} as updated_at from fx_pages""")
def _(t):
    return shape.shape_page(t.fx_pages).drop("meta")


@query("shape_category", """select slug, name, coalesce(description, '') as description,
  cast(parent_id as bigint) as parent_id, post_count from fx_taxonomies""")
def _(t):
    return shape.shape_category(t.fx_taxonomies)


@query("iso_utc", f"select event_id, {ISO.format('ts')} as iso, cast(null as string) as broken from events")
def _(t):
    return t.events.select(
        "event_id", times.iso_utc(F.col("ts").cast("timestamp")).alias("iso"),
        times.iso_utc(F.col("event_type")).alias("broken"))


@query("decode_meta", """select event_id, json_extract_string(props, '$.k') as k, cast(0 as int) as broken from events""")
def _(t):
    return t.events.select(
        "event_id", text.decode_meta(F.col("props"))["k"].alias("k"),
        F.size(text.decode_meta(F.col("event_type"))).alias("broken"))


def post_json() -> str:
    def s(c: str) -> str:
        return f"cast(to_json({c}) as string)"

    return f"""'{{"slug":' || {s('slug')} || ',"title":' || {s('title')} || ',"content":' || {s('content')}
  || ',"excerpt":' || {s("coalesce(excerpt, '')")} || ',"status":' || {s('status')} || ',"author":' || {s('author')}
  || ',"published_at":' || {s(ISO.format('published_at'))} || ',"updated_at":' || {s(ISO.format('updated_at'))}
  || ',"meta":' || meta_jsonb || '}}'"""


@query("export_collection", f"select {post_json()} as document from fx_posts where {VISIBLE}")
def _(t):
    from feedproj.plans.registered_feed import scratch

    path = scratch(t, "export")
    feed.export_collection(listing.visible(t.fx_posts), "post", path)
    return t.spark.read.text(path).withColumnRenamed("value", "document")


@query("collection", f"""select '{{"data":[' || string_agg({post_json()}, ',' order by published_at desc, id desc)
  || '],"next_cursor":"' || {base64url("strftime(min(published_at), '%Y-%m-%d %H:%M:%S')").replace('id ||', 'arg_min(id, (published_at, id)) ||')}
  || '"}}' as document
from (select * from fx_posts where {VISIBLE} order by published_at desc, id desc limit 20)""")
def _(t):
    page = listing.list_posts(t.fx_posts)
    rows = listing.page_rows(page.look_ahead, page.limit, listing.newest_first())
    return shape.collection(rows, "post", listing.newest_first())


@query("slug_pattern", r"""select page_id, regexp_full_match(regexp_extract(url, '([^/]*)$'), '[a-z0-9_-]+') as ok
from pages""")
def _(t):
    last = F.regexp_extract("url", "([^/]*)$", 1)
    return t.pages.select("page_id", text.slug_pattern(last).alias("ok"))
