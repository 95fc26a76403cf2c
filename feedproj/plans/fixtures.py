"""Feed-shaped tables derived from the driver's star schema.

Each text is SQL that both Spark and DuckDB read; ``sid``, ``sha`` and ``fmt``
cover the few functions that are named differently. Spark frames come from
``Tables``; the oracle texts put the same definitions into CTEs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from feedproj.session import use_utc
from feedproj.sources.state import SourceState

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "labels", "pages", "conversations")
AS_OF = "2024-06-01 00:00:00"
# Capture time up to which the feed counts as already applied.
APPLIED_UNTIL = "2024-01-15 00:00:00"


def sha(dialect: str, text: str) -> str:
    return f"sha2({text}, 256)" if dialect == "spark" else f"sha256({text})"


def sid(dialect: str, kind: str, key: str) -> str:
    return f"substr({sha(dialect, f'''concat('{kind}:', cast({key} as string))''')}, 1, 32)"


def fmt(dialect: str, ts: str) -> str:
    if dialect == "spark":
        return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')"
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def cents(col: str) -> str:
    return f"cast(round({col} * 100) as bigint)"


VERB = "case event_type when 'signup' then 'created' when 'error' then 'deleted' else 'updated' end"


def fixture_sql(d: str) -> dict[str, str]:
    """Name to SQL over the driver tables, in order of dependence."""
    return {
        # Posts as projected earlier, for the read queries.
        "fx_posts": f"""
            select {sid(d, 'post', 'o_orderkey')} as id, o_orderkey as source_post_id,
                   concat('order-', cast(o_orderkey as string)) as slug, o_orderpriority as title,
                   concat('Total ', cast({cents('o_totalprice')} as string)) as content,
                   case o_orderstatus when 'F' then 'done' end as excerpt,
                   case o_orderstatus when 'P' then 'draft' else 'publish' end as status,
                   c_name as author, cast(o_orderdate as timestamp) as published_at,
                   cast(o_orderdate + interval 1 day as timestamp) as updated_at,
                   case when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'F'
                        then cast(o_orderdate as timestamp) end as deleted_at,
                   concat('{{"k":"', o_orderstatus, '"}}') as meta_jsonb
            from orders join customer on o_custkey = c_custkey""",
        "fx_taxonomies": f"""
            select {sid(d, 'category', 'n_nationkey')} as id, n_nationkey as source_term_id,
                   'category' as taxonomy_type, lower(replace(n_name, '_', '-')) as slug, n_name as name,
                   cast(null as string) as description, n_regionkey as parent_id, n_nationkey as post_count,
                   case when n_regionkey = 4 then timestamp '2024-01-01 00:00:00' end as deleted_at
            from nation""",
        "fx_bridge": f"""
            select distinct {sid(d, 'post', 'l_orderkey')} as entity_id,
                   {sid(d, 'category', 's_nationkey')} as taxonomy_id
            from lineitem join supplier on l_suppkey = s_suppkey""",
        "fx_pages": f"""
            select {sid(d, 'page', 'p_partkey')} as id, p_partkey as source_post_id,
                   concat('part-', cast(p_partkey as string)) as slug, p_name as title, p_brand as content,
                   case p_type when 'ECONOMY' then 'draft' else 'publish' end as status,
                   cast(floor(p_partkey / 8) as bigint) as parent_id, p_size as menu_order,
                   cast(timestamp '2024-01-01 00:00:00' + p_size * interval 1 day as timestamp) as published_at,
                   cast(timestamp '2024-02-01 00:00:00' + p_size * interval 1 day as timestamp) as updated_at,
                   case when p_type = 'PROMO' then timestamp '2024-03-01 00:00:00' end as deleted_at,
                   concat('{{"brand":"', p_brand, '"}}') as meta_jsonb
            from part""",
        # The feed.
        "fx_feed": f"""
            select concat('ev-', cast(event_id as string)) as id,
                   concat('content.post.', {VERB}) as event_type, 1 as event_version,
                   'post' as aggregate_type, cast(user_id as string) as aggregate_id,
                   cast(row_number() over (partition by user_id order by ts, event_id) as bigint)
                       as aggregate_version,
                   cast(ts as timestamp) as source_updated_at, {sha(d, 'props')} as checksum,
                   concat('ev-', cast(event_id as string)) as correlation_id,
                   cast(null as string) as causation_id, props as payload,
                   cast(ts as timestamp) as created_at
            from events""",
        # The feed delivered twice: every event has a copy.
        "fx_redelivered": "select * from fx_feed union all select * from fx_feed",
        "fx_versions": f"""
            select aggregate_type, aggregate_id, max(aggregate_version) as latest_processed_version,
                   max(created_at) as latest_processed_at
            from fx_feed where created_at < timestamp '{APPLIED_UNTIL}'
            group by aggregate_type, aggregate_id""",
        "fx_ledger": f"""
            select id as event_id, checksum, created_at as processed_at
            from fx_feed where created_at < timestamp '{APPLIED_UNTIL}'""",
        # The source as it is now.
        "src_posts": f"""
            select cast(o_orderkey as string) as ID, 'post' as post_type,
                   case when {cents('o_totalprice')} > 49000000 then ' '
                        else concat('order-', cast(o_orderkey as string)) end as post_name,
                   case o_orderstatus when 'P' then 'draft' else 'publish' end as post_status,
                   concat('  ', o_orderpriority, ' ') as post_title,
                   concat('Total ', cast({cents('o_totalprice')} as string)) as post_content,
                   case o_orderstatus when 'F' then 'done' end as post_excerpt,
                   case o_orderpriority when '5-LOW' then '0000-00-00 00:00:00'
                        else {fmt(d, 'o_orderdate')} end as post_date_gmt,
                   case when {cents('o_totalprice')} < 1000000 then 'soon'
                        when o_orderpriority = '1-URGENT'
                        then concat(replace({fmt(d, 'o_orderdate')}, ' ', 'T'), '+02:00')
                        else {fmt(d, 'o_orderdate')} end as post_modified_gmt,
                   cast(o_custkey as string) as post_author, c_name as post_author_login
            from orders left join customer on o_custkey = c_custkey""",
        "src_pages": f"""
            select cast(p_partkey as string) as ID, 'page' as post_type,
                   concat('part-', cast(p_partkey as string)) as post_name,
                   case p_type when 'ECONOMY' then 'draft' else 'publish' end as post_status,
                   concat(p_name, ' ') as post_title, p_brand as post_content,
                   {fmt(d, "(timestamp '2024-01-01 00:00:00' + p_size * interval 1 day)")} as post_date_gmt,
                   {fmt(d, "(timestamp '2024-02-01 00:00:00' + p_size * interval 1 day)")} as post_modified_gmt,
                   case when p_partkey >= 8 then cast(cast(floor(p_partkey / 8) as bigint) as string) end
                       as post_parent,
                   cast(p_size as string) as menu_order
            from part""",
        "src_terms": """
            select cast(n_nationkey as string) as term_id, concat(' ', n_name) as name,
                   lower(replace(n_name, '_', '-')) as slug, r_name as description,
                   cast(n_regionkey as string) as parent, cast(n_nationkey * 3 as string) as count,
                   'category' as taxonomy
            from nation left join region on n_regionkey = r_regionkey""",
        "src_meta": """
            select l_orderkey as post_id, cast(l_linenumber as bigint) as meta_id,
                   concat('ship/', lower(l_returnflag)) as meta_key,
                   cast(cast(l_quantity as bigint) as string) as meta_value
            from lineitem""",
        "src_post_terms": """
            select l_orderkey as post_id, cast(s_nationkey as bigint) as term_id
            from lineitem join supplier on l_suppkey = s_suppkey""",
        # Failed work and its records.
        "fx_attempts": f"""
            select concat('ev-', cast(event_id as string)) as event_id,
                   case event_type when 'view' then 'commerce' else 'content' end as queue_name,
                   cast(floor(value) as int) as attempts, cast(ts as timestamp) as available_at,
                   case event_type when 'click' then cast(ts + interval 1 hour as timestamp) end as deadline,
                   event_type as last_error
            from events""",
    }


class Tables:
    """The driver tables and the fixtures above as Spark frames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        made = self._made
        if name not in made:
            if name in DRIVER_TABLES:
                made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in _SPARK_SQL:
                made[name] = self.sql(_SPARK_SQL[name])
            else:
                raise AttributeError(name)
        return made[name]

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables and fixtures it names."""
        words = set(_words(text))
        used = {n: getattr(self, n) for n in (*DRIVER_TABLES, *_SPARK_SQL) if n in words}
        # Braces of the text itself are doubled: ``spark.sql`` reads them as parameters.
        text = text.replace("{", "{{").replace("}", "}}")
        for n in used:
            text = _swap(text, n)
        used = {n: df for n, df in used.items() if f"{{{n}}}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def source(self) -> SourceState:
        return SourceState(self.src_posts, self.src_pages, self.src_terms, self.src_meta, self.src_post_terms)


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z_]+", text)


def _swap(text: str, name: str) -> str:
    """``from name`` / ``join name`` to a frame parameter of ``spark.sql``."""
    import re

    return re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)


_SPARK_SQL = fixture_sql("spark")
# The same links: an id is a hash of its key, so equal pairs are dropped while they are still numbers.
_SPARK_SQL["fx_bridge"] = f"""
    select {sid('spark', 'post', 'l_orderkey')} as entity_id, {sid('spark', 'category', 's_nationkey')} as taxonomy_id
    from (select distinct l_orderkey, s_nationkey from lineitem join supplier on l_suppkey = s_suppkey)"""
_DUCK_SQL = fixture_sql("duckdb")


def with_fixtures(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: the named fixtures (and what they need) as CTEs before ``body``."""
    known = {**_DUCK_SQL, **(extra or {})}
    need: set[str] = set()

    def add(text: str) -> None:
        for word in _words(text):
            if word in known and word not in need:
                need.add(word)
                add(known[word])

    add(body)
    for n in names:
        need.add(n)
        add(known[n])
    ctes = ",\n".join(f"{n} as ({known[n]})" for n in known if n in need)
    body = body.lstrip()
    # A body with CTEs of its own starts with a comma.
    if body.startswith(","):
        return f"with recursive {ctes}{body}" if ctes else f"with recursive {body[1:]}"
    return f"with recursive {ctes}\n{body}" if ctes else body
