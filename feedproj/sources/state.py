"""Current source state for a set of aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedproj.operators.canonical import EntitySpec


@dataclass(frozen=True)
class SourceState:
    """One consistent snapshot of the source: raw rows as the source keeps them.

    ``posts``, ``pages``: one row per entity with the raw columns; ``terms``: one
    row per category; ``meta``: post_id, meta_id, meta_key, meta_value;
    ``post_terms``: post_id, term_id. ``extra`` holds further kinds by name.
    """

    posts: DataFrame
    pages: DataFrame
    terms: DataFrame
    meta: DataFrame
    post_terms: DataFrame
    extra: dict[str, DataFrame] | None = None

    def rows(self, kind: str) -> DataFrame:
        known = {"post": self.posts, "page": self.pages, "category": self.terms, **(self.extra or {})}
        if kind not in known:
            raise ValueError(f"the source has no rows of kind {kind!r}; give them in ``extra``")
        return known[kind]


def meta_maps(meta: DataFrame) -> DataFrame:
    """``post_id, meta``: first value of each key, by ``meta_id``.

    The first value is picked by a min per (post, key), so a key repeated many
    times is reduced before it moves; the map then holds distinct keys only.
    """
    first = (
        meta.groupBy("post_id", "meta_key")
        .agg(F.min(F.struct("meta_id", F.coalesce("meta_value", F.lit("")).alias("v"))).alias("_first"))
    )
    return first.groupBy("post_id").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col("meta_key").cast("string"), F.col("_first.v").cast("string"))))
        ).alias("meta")
    )


def category_lists(post_terms: DataFrame) -> DataFrame:
    """``post_id, category_ids``: ascending distinct term ids, sets merged task by task."""
    ids = F.sort_array(F.collect_set(F.col("term_id").cast("bigint")))
    return post_terms.groupBy("post_id").agg(ids.alias("category_ids"))


def load_source_state(source: SourceState, spec: EntitySpec, keys: DataFrame | None = None) -> DataFrame:
    """Raw rows of one kind with ``_key`` and, for posts and pages, meta and categories.

    ``keys`` (a ``_key`` column) limits every source table to the touched entities
    before anything is grouped; it filters by semi join, so a small batch prunes
    large source tables without shuffling them.
    """
    raw = source.rows(spec.kind).withColumn("_key", F.col(spec.source_key).try_cast("bigint"))
    meta, terms = source.meta, source.post_terms
    if keys is not None:
        raw = raw.join(keys, "_key", "left_semi")
        by_post = keys.select(F.col("_key").alias("post_id"))
        meta = meta.join(by_post, "post_id", "left_semi")
        terms = terms.join(by_post, "post_id", "left_semi")
    needs = spec.extract(F.lit(None).cast("timestamp"))
    if "meta" in needs and "meta" not in raw.columns:
        raw = raw.join(meta_maps(meta).withColumnRenamed("post_id", "_key"), "_key", "left")
    # Kinds whose raw rows carry their own id lists need no pair table.
    if "category_ids" in needs and "category_ids" not in raw.columns:
        raw = raw.join(category_lists(terms).withColumnRenamed("post_id", "_key"), "_key", "left")
    return raw
