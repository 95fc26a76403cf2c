"""Public row shapes and response documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedproj.functions.text import decode_meta
from feedproj.functions.times import iso_utc


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _zero(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind)).alias(name)


def _dated() -> list[Column]:
    return [
        iso_utc(F.col("published_at")).alias("published_at"),
        iso_utc(F.col("updated_at")).alias("updated_at"),
        decode_meta(F.col("meta_jsonb")).alias("meta"),
    ]


def post_shape() -> list[Column]:
    return [F.col("slug"), F.col("title"), F.col("content"), _blank("excerpt"), F.col("status"),
            _blank("author"), *_dated()]


def page_shape() -> list[Column]:
    return [F.col("slug"), F.col("title"), F.col("content"), F.col("status"),
            _zero("parent_id", "bigint"), _zero("menu_order", "int"), *_dated()]


def category_shape() -> list[Column]:
    return [F.col("slug"), F.col("name"), _blank("description"), _zero("parent_id", "bigint"),
            _zero("post_count", "int")]


def shape_post(df: DataFrame) -> DataFrame:
    return df.select(*post_shape())


def shape_page(df: DataFrame) -> DataFrame:
    return df.select(*page_shape())


def shape_category(df: DataFrame) -> DataFrame:
    return df.select(*category_shape())


SHAPES = {"post": post_shape, "page": page_shape, "category": category_shape}


def collection(page_of_rows: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    """One row ``document``: ``{"data": [...], "next_cursor": ...}``.

    Takes the rows of ``listing.page_rows``: one page, at most 200 of them.
    """
    row = F.to_json(F.struct(*SHAPES[kind]()), {"ignoreNullFields": "false"})
    token = F.to_json(F.struct(F.max("next_cursor").alias("t")), {"ignoreNullFields": "false"})
    return (
        page_of_rows.withColumn("_n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))
        .withColumn("_json", row)
        .agg(
            F.sort_array(F.collect_list(F.struct("_n", "_json"))).alias("_rows"),
            # '{"t":...}' without its name and closing brace.
            F.regexp_extract(token, r"^\{\"t\":(.*)\}$", 1).alias("_token"),
        )
        .select(
            F.concat(
                F.lit('{"data":['), F.array_join(F.transform("_rows", lambda r: r["_json"]), ","),
                F.lit('],"next_cursor":'), F.col("_token"), F.lit("}"),
            ).alias("document")
        )
    )


def documents(df: DataFrame, kind: str) -> DataFrame:
    """Every row as one JSON document, key columns kept beside it."""
    return df.select(
        "slug", F.to_json(F.struct(*SHAPES[kind]()), {"ignoreNullFields": "false"}).alias("document")
    )
