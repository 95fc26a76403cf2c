"""Commerce projections: the same spec-driven operators on product tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.functions.ids import surrogate_id
from feedproj.functions.text import canonical_ids_json, id_list
from feedproj.functions.times import instant
from feedproj.operators.canonical import EntitySpec
from feedproj.operators.kinds import CONTENT_KINDS
from feedproj.schema import _fields

PRODUCTS = _fields("""
    id string
    source_product_id bigint
    sku string
    slug string
    name string
    description string
    status string
    product_type string
    price decimal(18,2)
    sale_price decimal(18,2)
    currency string
    stock_status string
    featured boolean
    deleted_at timestamp
    checksum string
    created_at timestamp
    updated_at timestamp
    synced_at timestamp
""")
VARIATIONS = _fields("""
    id string
    source_variation_id bigint
    product_id string
    sku string
    price decimal(18,2)
    sale_price decimal(18,2)
    stock_status string
    deleted_at timestamp
    checksum string
    attributes_jsonb string
    created_at timestamp
    updated_at timestamp
    synced_at timestamp
""")
ATTRIBUTES = _fields("""
    id string
    source_attribute_id bigint
    name string
    slug string
    deleted_at timestamp
    checksum string
    created_at timestamp
    synced_at timestamp
""")
ATTRIBUTE_TERMS = _fields("""
    id string
    attribute_id string
    source_term_id bigint
    name string
    slug string
    deleted_at timestamp
    checksum string
    created_at timestamp
    synced_at timestamp
""")
COMMERCE_CATEGORIES = _fields("""
    id string
    source_term_id bigint
    slug string
    name string
    description string
    deleted_at timestamp
    checksum string
    created_at timestamp
    updated_at timestamp
    synced_at timestamp
""")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _ids(name: str) -> Column:
    return F.coalesce(id_list(F.col(name)), F.array().cast("array<bigint>"))


def _money(name: str) -> Column:
    return F.col(name).try_cast("decimal(18,2)")


def _shown(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]


PRODUCT = EntitySpec(
    kind="product",
    source_key="product_id",
    numeric=("product_id",),
    text=("slug", "status"),
    dates=(),
    discriminator=None,
    extract=lambda as_of: {
        "product_key": F.col("product_id").try_cast("bigint"),
        **{c: _text(c) for c in ("sku", "slug", "name", "description", "status", "product_type", "currency",
                                 "stock_status")},
        "price": _money("price"),
        "sale_price": _money("sale_price"),
        "featured": F.coalesce(F.col("featured").try_cast("boolean"), F.lit(False)),
        "category_ids": _ids("category_ids"),
        "attribute_term_ids": _ids("attribute_term_ids"),
    },
    key="product_key",
    trims="name",
    digest=lambda: _shown("product_key", "sku", "slug", "name", "description", "status", "product_type",
                          "price", "sale_price", "currency", "stock_status", "featured")
    + [canonical_ids_json(F.col(c)) for c in ("category_ids", "attribute_term_ids")],
    ddl=PRODUCTS,
    natural_key="source_product_id",
    projected=lambda now: {"source_product_id": F.col("product_key"), "updated_at": now},
    links=(("category_ids", "commerce_category"), ("attribute_term_ids", "attribute_term")),
    domain="commerce",
)
VARIATION = EntitySpec(
    kind="variation",
    source_key="variation_id",
    numeric=("variation_id", "product_id"),
    text=("sku",),
    dates=(),
    discriminator=None,
    extract=lambda as_of: {
        "variation_key": F.col("variation_id").try_cast("bigint"),
        "product_key": F.col("product_id").try_cast("bigint"),
        "sku": _text("sku"),
        "price": _money("price"),
        "sale_price": _money("sale_price"),
        "stock_status": _text("stock_status"),
        "attributes_jsonb": _text("attributes"),
    },
    key="variation_key",
    trims="sku",
    digest=lambda: _shown("variation_key", "product_key", "sku", "price", "sale_price", "stock_status",
                          "attributes_jsonb"),
    ddl=VARIATIONS,
    natural_key="source_variation_id",
    projected=lambda now: {
        "source_variation_id": F.col("variation_key"),
        "product_id": product_id(F.col("product_key")),
        "updated_at": now,
    },
    domain="commerce",
)
COMMERCE_CATEGORY = EntitySpec(
    kind="commerce_category",
    source_key="term_id",
    numeric=("term_id",),
    text=("name", "slug"),
    dates=(),
    discriminator=None,
    extract=lambda as_of: {
        "term_id": F.col("term_id").try_cast("bigint"),
        **{c: _text(c) for c in ("slug", "name", "description")},
    },
    key="term_id",
    trims="name",
    digest=lambda: _shown("term_id", "name", "slug", "description"),
    ddl=COMMERCE_CATEGORIES,
    natural_key="source_term_id",
    projected=lambda now: {"source_term_id": F.col("term_id"), "updated_at": now},
    domain="commerce",
)
ATTRIBUTE = EntitySpec(
    kind="attribute",
    source_key="attribute_id",
    numeric=("attribute_id",),
    text=("name", "slug"),
    dates=(),
    discriminator=None,
    extract=lambda as_of: {
        "attribute_key": F.col("attribute_id").try_cast("bigint"), "name": _text("name"), "slug": _text("slug"),
    },
    key="attribute_key",
    trims="name",
    digest=lambda: _shown("attribute_key", "name", "slug"),
    ddl=ATTRIBUTES,
    natural_key="source_attribute_id",
    projected=lambda now: {"source_attribute_id": F.col("attribute_key")},
    domain="commerce",
)
ATTRIBUTE_TERM = EntitySpec(
    kind="attribute_term",
    source_key="term_id",
    numeric=("term_id", "attribute_id"),
    text=("name", "slug"),
    dates=(),
    discriminator=None,
    extract=lambda as_of: {
        "term_id": F.col("term_id").try_cast("bigint"),
        "attribute_key": F.col("attribute_id").try_cast("bigint"),
        "name": _text("name"),
        "slug": _text("slug"),
    },
    key="term_id",
    trims="name",
    digest=lambda: _shown("term_id", "attribute_key", "name", "slug"),
    ddl=ATTRIBUTE_TERMS,
    natural_key="source_term_id",
    projected=lambda now: {
        "source_term_id": F.col("term_id"), "attribute_id": surrogate_id("attribute", F.col("attribute_key")),
    },
    domain="commerce",
)
COMMERCE = (COMMERCE_CATEGORY, ATTRIBUTE, ATTRIBUTE_TERM, PRODUCT, VARIATION)
COMMERCE_KINDS = CONTENT_KINDS.with_(COMMERCE)


def product_id(key: Column) -> Column:
    return surrogate_id("product", key)


def inventory(stock: DataFrame, as_of) -> DataFrame:
    """``product_id, quantity, stock_status, backorders_allowed`` from stock movements.

    ``stock``: product_key, quantity (signed), backorders (boolean).
    """
    return (
        stock.groupBy("product_key")
        .agg(F.sum("quantity").cast("bigint").alias("quantity"), F.max("backorders").alias("backorders_allowed"))
        .select(
            product_id(F.col("product_key")).alias("product_id"), "quantity",
            F.when(F.col("quantity") > 0, "instock")
            .when(F.col("backorders_allowed"), "onbackorder")
            .otherwise("outofstock").alias("stock_status"),
            "backorders_allowed",
            instant(as_of).alias("updated_at"),
        )
    )


def product_links(pairs: DataFrame, terms: DataFrame, left: str, right: str) -> DataFrame:
    """Product to attribute term (or category): pairs whose term is known, once each.

    ``pairs``: product_key, source_term_id. Copies collapse before the join.
    """
    once = pairs.select("product_key", "source_term_id").distinct()
    known = terms.select("source_term_id", F.col("id").alias(right))
    return once.join(known, "source_term_id").select(
        product_id(F.col("product_key")).alias(left), right)


def list_products(products: DataFrame, min_price=None, max_price=None, product_type: str | None = None,
                  in_stock: bool = False, sort: str = "price", descending: bool = False,
                  limit: int = 20) -> DataFrame:
    """Filtered, sorted top of the live, published products."""
    kept = products.where(F.col("deleted_at").isNull() & (F.col("status") == "publish"))
    if min_price is not None:
        kept = kept.where(F.col("price") >= F.lit(min_price).cast("decimal(18,2)"))
    if max_price is not None:
        kept = kept.where(F.col("price") <= F.lit(max_price).cast("decimal(18,2)"))
    if product_type is not None:
        kept = kept.where(F.col("product_type") == product_type)
    if in_stock:
        kept = kept.where(F.col("stock_status") == "instock")
    first = F.col(sort).desc() if descending else F.col(sort).asc()
    return kept.orderBy(first, "id").limit(limit)


def product_report(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per product type: products, priced range, units, and products out of stock."""
    stock = inventory.select(
        F.col("product_id").alias("id"), "quantity", F.col("stock_status").alias("_stock"))
    return (
        products.where(F.col("deleted_at").isNull())
        .join(stock, "id", "left")
        .groupBy("product_type")
        .agg(
            F.count(F.lit(1)).alias("n_products"),
            F.min("price").cast("decimal(18,2)").alias("lowest_price"),
            F.max("price").cast("decimal(18,2)").alias("highest_price"),
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"),
            F.count(F.when(F.coalesce("_stock", F.lit("outofstock")) != "instock", 1)).alias("n_unavailable"),
        )
    )


def category_products(products: DataFrame, links: DataFrame, categories: DataFrame) -> DataFrame:
    """Live products per category, zero included."""
    live = products.where(F.col("deleted_at").isNull()).select(F.col("id").alias("product_id"))
    counted = links.join(live, "product_id", "left_semi").groupBy("category_id").agg(
        F.count(F.lit(1)).alias("_n"))
    return categories.where(F.col("deleted_at").isNull()).join(
        counted, F.col("id") == F.col("category_id"), "left"
    ).select("slug", F.coalesce("_n", F.lit(0)).alias("n_products"))


def product_attributes(links: DataFrame, terms: DataFrame, attributes: DataFrame) -> DataFrame:
    """Which terms of which attributes a product has: ``product_id``, ``attribute``, ``term``, ``attribute_term_id``.

    ``links``: the bridge (entity_id, taxonomy_id); links to anything but a live term of a
    live attribute fall away.
    """
    named = (
        terms.where("deleted_at IS NULL").select(F.col("id").alias("attribute_term_id"), F.col("slug").alias("term"), "attribute_id")
        .join(
            attributes.where("deleted_at IS NULL").select(F.col("id").alias("attribute_id"), F.col("slug").alias("attribute")),
            "attribute_id",
        )
    )
    return (
        links.select(F.col("entity_id").alias("product_id"), F.col("taxonomy_id").alias("attribute_term_id"))
        .join(named, "attribute_term_id")
        .select("product_id", "attribute", "term", "attribute_term_id")
    )


def _matching(had: DataFrame, selected: dict[str, list[str]]) -> DataFrame:
    """Products with one of the terms of every attribute named."""
    wanted = F.lit(False)
    for name, terms in selected.items():
        wanted = wanted | ((F.col("attribute") == name) & F.col("term").isin(*terms))
    each = had.where(wanted).select("product_id", "attribute").distinct()
    return each.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(selected)).select("product_id")


def product_facets(
    products: DataFrame, attributes: DataFrame, selected: dict[str, list[str]] | None = None
) -> DataFrame:
    """How many live, published products each term, each attribute and all of them have.

    ``attributes``: product_id, attribute, term (see :func:`product_attributes`). A product
    with several terms of an attribute counts once for the attribute. ``selected`` (terms by
    attribute) narrows the products: any of an attribute's terms, and all attributes named.
    Rows: ``attribute``, ``term`` (NULL: all of them), ``n_products``, ``lowest_price``,
    ``highest_price`` of the narrowed products.

    Distinct counts come from bitmaps by range of product numbers, built once for each term
    inside the tasks and merged upwards over the grouping sets: products move once, not
    once for every level, and a hot term is as many groups as it has ranges.
    """
    live = products.where(F.col("deleted_at").isNull() & (F.col("status") == "publish")).select(
        F.col("id").alias("product_id"), "source_product_id", "price")
    had = live.join(attributes.select("product_id", "attribute", "term"), "product_id")
    if selected:
        had = had.join(_matching(had, selected), "product_id", "left_semi")
    number = F.col("source_product_id")
    by_term = had.groupBy("attribute", "term", F.bitmap_bucket_number(number).alias("_range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"),
        F.min("price").alias("_low"), F.max("price").alias("_high"),
    )
    levels = [["attribute", "term", "_range"], ["attribute", "_range"], ["_range"]]
    merged = by_term.groupingSets(levels, "attribute", "term", "_range").agg(
        F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
    )
    # Products that none of the selected terms have are still counted: none.
    none = merged.sparkSession.range(1).select(*[
        (F.lit(0) if f.name == "_n" else F.lit(None)).cast(f.dataType).alias(f.name) for f in merged.schema])
    return merged.unionByName(none).groupBy("attribute", "term").agg(
        F.sum("_n").cast("bigint").alias("n_products"), F.min("_low").alias("lowest_price"), F.max("_high").alias("highest_price"))
