"""Read queries over the projections: listings, slug lookup, page numbering.

Listings are lazy: scan, filter, semi join, top-k. Filters are plain
comparisons on stored columns, so they reach the parquet scan.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedproj.functions.cursor import encode_cursor
from feedproj.functions.times import instant
from feedproj.operators.skew import number_all
from feedproj.schema import PAGE_LIMITS, PUBLIC_STATUSES


@dataclass(frozen=True)
class Page:
    """``rows`` of one page in order, and the token of the next (None on the last)."""

    rows: DataFrame
    look_ahead: DataFrame
    limit: int
    sort: str

    def next_cursor(self) -> str | None:
        """Reads at most ``limit + 1`` (201) rows to the driver."""
        return next_cursor(self.look_ahead, self.limit, self.sort)


def clamp_limit(limit: int | None, kind: str) -> int:
    default, most = PAGE_LIMITS[kind]
    return min(limit if limit is not None and limit > 0 else default, most)


def check_status(status: str | None) -> str:
    """Only the public set may be listed."""
    if not status:
        return PUBLIC_STATUSES[0]
    if status not in PUBLIC_STATUSES:
        raise ValueError(f"invalid status; accepted: {', '.join(PUBLIC_STATUSES)}")
    return status


def check_cursor(token: str | None, strict: bool = True) -> dict | None:
    """Fields of a cursor argument; a bad one raises, or is ignored when not strict."""
    if not token:
        return None
    plain = re.sub(r"[^A-Za-z0-9_-]", "", token)
    try:
        body = json.loads(base64.urlsafe_b64decode(plain + "=" * (-len(plain) % 4)))
    except ValueError:
        body = None
    if isinstance(body, dict) and body.get("s") is not None and body.get("id") is not None:
        return body
    if strict:
        raise ValueError("invalid cursor token")
    return None


def check_time(value, strict: bool = True) -> Column | None:
    """A lower bound argument; unreadable text raises, or is dropped when not strict."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError:
            if strict:
                raise
            return None
    return instant(value)


def visible(df: DataFrame, status: str | None = "publish", taxonomy: str | None = None) -> DataFrame:
    """Not deleted, and public."""
    kept = df.where(F.col("deleted_at").isNull())
    if taxonomy is not None:
        return kept.where(F.col("taxonomy_type") == taxonomy)
    return kept.where(F.col("status") == check_status(status))


def in_category(posts: DataFrame, bridge: DataFrame, taxonomies: DataFrame, slug: str) -> DataFrame:
    """Posts linked to a live category with this slug."""
    category = taxonomies.where((F.col("slug") == slug) & F.col("deleted_at").isNull()).select(
        F.col("id").alias("taxonomy_id")
    )
    members = bridge.join(category, "taxonomy_id").select(F.col("entity_id").alias("id"))
    return posts.join(members, "id", "left_semi")


def seek_before(sort: str, value: Column, row_id: str) -> Column:
    """Rows after a cursor in (sort desc, id desc) order."""
    return (F.col(sort) < value) | ((F.col(sort) == value) & (F.col("id") < row_id))


def seek_after(sort: str, value: Column, row_id: str) -> Column:
    """Rows after a cursor in (sort asc, id asc) order."""
    return (F.col(sort) > value) | ((F.col(sort) == value) & (F.col("id") > row_id))


def next_cursor(look_ahead: DataFrame, limit: int, sort: str) -> str | None:
    tail = look_ahead.select(encode_cursor(F.col(sort), F.col("id")).alias("c")).take(limit + 1)
    return tail[limit - 1]["c"] if len(tail) > limit else None


def page_rows(look_ahead: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The page's rows with ``has_more`` and, on its last row, the ``next_cursor``.

    The window runs over the ``limit + 1`` rows of one page only.
    """
    sort = "published_at" if "published_at" in look_ahead.columns else "name"
    return (
        look_ahead.withColumn("_n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))
        .withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))) > limit)
        .where(F.col("_n") <= limit)
        .withColumn(
            "next_cursor",
            F.when(F.col("has_more") & (F.col("_n") == limit), encode_cursor(F.col(sort), F.col("id"))),
        )
        .drop("_n")
    )


def newest_first() -> list[Column]:
    return [F.col("published_at").desc(), F.col("id").desc()]


def by_name() -> list[Column]:
    return [F.col("name").asc(), F.col("id").asc()]


def _dated_listing(df, kind, status, published_after, updated_after, cursor, limit, strict) -> Page:
    size = clamp_limit(limit, kind)
    rows = visible(df, status)
    after = check_time(published_after, strict)
    if after is not None:
        rows = rows.where(F.col("published_at") > after)
    after = check_time(updated_after, strict)
    if after is not None:
        rows = rows.where(F.col("updated_at") > after)
    at = check_cursor(cursor, strict)
    if at is not None:
        rows = rows.where(seek_before("published_at", instant(at["s"]), at["id"]))
    ordered = rows.orderBy(*newest_first())
    return Page(ordered.limit(size), ordered.limit(size + 1), size, "published_at")


def list_pages(pages: DataFrame, status: str | None = None, published_after=None, cursor: str | None = None,
               limit: int | None = None, updated_after=None, strict: bool = True) -> Page:
    return _dated_listing(pages, "page", status, published_after, updated_after, cursor, limit, strict)


def list_posts(posts: DataFrame, bridge: DataFrame | None = None, taxonomies: DataFrame | None = None,
               status: str | None = None, published_after=None, category_slug: str | None = None,
               cursor: str | None = None, limit: int | None = None, updated_after=None,
               strict: bool = True) -> Page:
    if category_slug:
        posts = in_category(posts, bridge, taxonomies, category_slug)
    return _dated_listing(posts, "post", status, published_after, updated_after, cursor, limit, strict)


def list_categories(taxonomies: DataFrame, cursor: str | None = None, limit: int | None = None,
                    strict: bool = True) -> Page:
    size = clamp_limit(limit, "category")
    rows = visible(taxonomies, taxonomy="category")
    at = check_cursor(cursor, strict)
    if at is not None:
        rows = rows.where(seek_after("name", F.lit(at["s"]), at["id"]))
    ordered = rows.orderBy(*by_name())
    return Page(ordered.limit(size), ordered.limit(size + 1), size, "name")


def find_by_slug(df: DataFrame, slug: str) -> DataFrame:
    """At most one visible row; of several with the slug, the one with the lowest id."""
    kept = visible(df, taxonomy="category") if "taxonomy_type" in df.columns else visible(df)
    return kept.where(F.col("slug") == slug).orderBy("id").limit(1)


def find_by_slugs(df: DataFrame, slugs: DataFrame) -> DataFrame:
    """One visible row (lowest id) for every slug asked for, in one pass."""
    kept = visible(df, taxonomy="category") if "taxonomy_type" in df.columns else visible(df)
    wanted = kept.join(slugs.select("slug").distinct(), "slug", "left_semi")
    rest = [c for c in kept.columns if c not in ("slug", "id")]
    return wanted.groupBy("slug").agg(
        F.min("id").alias("id"), F.min_by(F.struct(*rest), "id").alias("_row")
    ).select("slug", "id", *[f"_row.{c}" for c in rest])


def paginate_all(df: DataFrame, size: int, order: list[Column], sort: str) -> DataFrame:
    """Every row with its page number and, on a page's last row, the next page's cursor."""
    placed = number_all(df, order, "_at")
    total = placed.select(F.count(F.lit(1))).scalar()
    last = (F.pmod(F.col("_at") + 1, F.lit(size)) == 0) & (F.col("_at") + 1 < total)
    return placed.withColumn("page", F.floor(F.col("_at") / size) + 1).withColumn(
        "next_cursor", F.when(last, encode_cursor(F.col(sort), F.col("id")))
    ).drop("_at")
