"""Raw source rows to validated, normalised, checksummed canonical rows.

An ``EntitySpec`` holds everything that differs between entity kinds, as Column
expressions, so one set of operators serves posts, pages, categories and any
kind a user adds (see ``operators.commerce``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.functions.text import (
    canonical_ids_json,
    canonical_map_json,
    id_list,
    is_blank,
    leading_number,
    trimmed,
)
from feedproj.functions.times import atom, is_unset, parse_gmt
from feedproj.schema import PAGES, POSTS, TAXONOMIES


@dataclass(frozen=True)
class EntitySpec:
    """How one entity kind is read, checked, canonicalised and projected."""

    kind: str
    # Raw source side.
    source_key: str
    numeric: tuple[str, ...]
    text: tuple[str, ...]
    dates: tuple[str, ...]
    discriminator: tuple[str, str] | None
    extract: Callable[[object], dict[str, Column]]
    # Canonical side; ``key`` names the entity's id in the canonical row.
    key: str
    trims: str
    digest: Callable[[], list[Column]]
    # Projection side.
    ddl: str
    natural_key: str
    projected: Callable[[Column], dict[str, Column]]
    insert_only: tuple[str, ...] = ("id", "created_at", "source_entity_type", "taxonomy_type")
    # Many-to-many links: (list column of the canonical row, kind its source ids belong to).
    links: tuple[tuple[str, str], ...] = ()
    # Events: ``<domain>.<kind>.<verb>``; upserts read the source, tombstones don't.
    domain: str = "content"
    upserts: tuple[str, ...] = ("created", "updated")
    tombstones: tuple[str, ...] = ("deleted",)

    @property
    def event_types(self) -> tuple[str, ...]:
        return tuple(f"{self.domain}.{self.kind}.{verb}" for verb in (*self.upserts, *self.tombstones))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _number(name: str, kind: str = "bigint") -> Column:
    return leading_number(F.col(name), kind)


def _post_columns(as_of) -> dict[str, Column]:
    return {
        "post_id": _number("ID"),
        "title": _text("post_title"),
        "content": _text("post_content"),
        "excerpt": _text("post_excerpt"),
        "slug": _text("post_name"),
        "status": _text("post_status"),
        "author": F.coalesce(
            F.col("post_author_login").cast("string"), F.col("post_author").cast("string"), F.lit("")
        ),
        "published_at": parse_gmt(F.col("post_date_gmt"), as_of),
        "modified_at": parse_gmt(F.col("post_modified_gmt"), as_of),
        "category_ids": F.coalesce(id_list(F.col("category_ids")), F.array().cast("array<bigint>")),
        "meta": F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>")),
    }


def _page_columns(as_of) -> dict[str, Column]:
    return {
        "post_id": _number("ID"),
        "title": _text("post_title"),
        "content": _text("post_content"),
        "slug": _text("post_name"),
        "status": _text("post_status"),
        "parent_id": _number("post_parent"),
        "menu_order": _number("menu_order", "int"),
        "published_at": parse_gmt(F.col("post_date_gmt"), as_of),
        "modified_at": parse_gmt(F.col("post_modified_gmt"), as_of),
        "meta": F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>")),
    }


def _category_columns(_as_of) -> dict[str, Column]:
    return {
        "term_id": _number("term_id"),
        "name": _text("name"),
        "slug": _text("slug"),
        "description": _text("description"),
        "parent_id": _number("parent"),
        "post_count": _number("count", "int"),
    }


def _cols(*names: str) -> list[Column]:
    return [F.col(n).cast("string") for n in names]


# Field order of the three digests.
def _post_digest() -> list[Column]:
    return [
        *_cols("post_id", "title", "content", "excerpt", "slug", "status", "author"),
        atom(F.col("published_at")),
        atom(F.col("modified_at")),
        canonical_ids_json(F.col("category_ids")),
        F.col("meta_json"),
    ]


def _page_digest() -> list[Column]:
    return [
        *_cols("post_id", "title", "content", "slug", "status", "parent_id", "menu_order"),
        atom(F.col("published_at")),
        atom(F.col("modified_at")),
        F.col("meta_json"),
    ]


def _category_digest() -> list[Column]:
    return _cols("term_id", "name", "slug", "description", "parent_id", "post_count")
# End of fixed values.


def _post_projected(_now: Column) -> dict[str, Column]:
    return {
        "source_post_id": F.col("post_id"),
        "source_entity_type": F.lit("post"),
        "updated_at": F.col("modified_at"),
        "meta_jsonb": F.col("meta_json"),
    }


def _page_projected(_now: Column) -> dict[str, Column]:
    return {
        "source_post_id": F.col("post_id"),
        "source_entity_type": F.lit("page"),
        "updated_at": F.col("modified_at"),
        "meta_jsonb": F.col("meta_json"),
    }


def _category_projected(now: Column) -> dict[str, Column]:
    return {
        "source_term_id": F.col("term_id"),
        "taxonomy_type": F.lit("category"),
        "updated_at": now,
    }


POST = EntitySpec(
    kind="post",
    source_key="ID",
    numeric=("ID",),
    text=("post_name", "post_status"),
    dates=("post_date_gmt", "post_modified_gmt"),
    discriminator=("post_type", "post"),
    extract=_post_columns,
    key="post_id",
    trims="title",
    digest=_post_digest,
    ddl=POSTS,
    natural_key="source_post_id",
    projected=_post_projected,
    links=(("category_ids", "category"),),
)
PAGE = EntitySpec(
    kind="page",
    source_key="ID",
    numeric=("ID",),
    text=("post_name", "post_status"),
    dates=("post_date_gmt", "post_modified_gmt"),
    discriminator=("post_type", "page"),
    extract=_page_columns,
    key="post_id",
    trims="title",
    digest=_page_digest,
    ddl=PAGES,
    natural_key="source_post_id",
    projected=_page_projected,
)
CATEGORY = EntitySpec(
    kind="category",
    source_key="term_id",
    numeric=("term_id",),
    text=("name", "slug"),
    dates=(),
    discriminator=("taxonomy", "category"),
    extract=_category_columns,
    key="term_id",
    trims="name",
    digest=_category_digest,
    ddl=TAXONOMIES,
    natural_key="source_term_id",
    projected=_category_projected,
)
CONTENT = (CATEGORY, PAGE, POST)


def violations(spec: EntitySpec) -> Column:
    """Codes of the broken rules. Dates are looked at only when nothing else is broken."""
    checks = [
        F.when(~F.coalesce(F.col(c).try_cast("bigint") > 0, F.lit(False)), F.lit(f"number:{c}"))
        for c in spec.numeric
    ]
    checks += [F.when(is_blank(F.col(c)), F.lit(f"text:{c}")) for c in spec.text]
    if spec.discriminator:
        name, wanted = spec.discriminator
        checks.append(F.when(F.col(name) != wanted, F.lit(f"kind:{name}")))
    broken = F.array_compact(F.array(*checks))
    if not spec.dates:
        return broken
    # The first bad date ends the check.
    bad_date = F.coalesce(
        *[F.when(~_date_is_usable(F.col(c)), F.lit(f"date:{c}")) for c in spec.dates]
    )
    return F.when((F.size(broken) == 0) & bad_date.isNotNull(), F.array(bad_date)).otherwise(broken)


def _date_is_usable(col: Column) -> Column:
    """Unset, or acceptable and readable by the extraction rule (a ``-05:00`` date is not).

    What the extraction rule reads is always acceptable, so that rule alone decides.
    """
    return is_unset(col) | parse_gmt(col, F.lit(None).cast("timestamp")).isNotNull()


def validate(df: DataFrame, spec: EntitySpec) -> tuple[DataFrame, DataFrame]:
    """(rows that hold all rules, broken rows with their ``violations``)."""
    checked = df.withColumn("violations", violations(spec))
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)


def extract(df: DataFrame, spec: EntitySpec, as_of) -> DataFrame:
    """Typed source rows: numbers cast, missing text blank, unset dates ``as_of``."""
    return df.select(*[c.alias(n) for n, c in spec.extract(as_of).items()])


def canonicalise(typed: DataFrame, spec: EntitySpec) -> DataFrame:
    """Trimmed title or name, and the order-insensitive ``checksum``.

    The JSON of ``meta`` is built once, as ``meta_json``, for the digest and the projection.
    """
    rows = typed.withColumn(spec.trims, trimmed(F.col(spec.trims)))
    if "meta" in typed.columns:
        rows = rows.withColumn("meta_json", canonical_map_json(F.col("meta")))
    return rows.withColumn("checksum", checksum(spec))


def checksum(spec: EntitySpec) -> Column:
    # All inputs are non-null after extraction; concat_ws would skip a NULL.
    return F.sha2(F.concat_ws("\0", *spec.digest()), 256)


def canonical_rows(raw: DataFrame, spec: EntitySpec, as_of) -> DataFrame:
    """Validated raw rows all the way to canonical rows."""
    good, _ = validate(raw, spec)
    return canonicalise(extract(good, spec, as_of), spec)
