"""Helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedproj.session import checkpointed

HOT_ROWS = 1_000_000
NULL_SALTS = 4096


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS
) -> DataFrame:
    """All keys with more rows than one task should take, and how many ways to split each.

    There are at most as many as all rows divided by ``rows``. Whether the list is
    broadcast is left to Spark, which goes by its size.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows)
        .select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_ways"))
    )


def spread(many: DataFrame, hot: DataFrame, keys: Sequence[str], salt_by: Sequence[str]) -> DataFrame:
    """Add ``_salt``: 0 for ordinary keys, a hash of ``salt_by`` for hot and for NULL ones.

    Never a random number, so retried tasks agree. A NULL key meets no row, so any
    salt will do; without one all NULLs would land in the same task.
    """
    mixed = F.xxhash64(*salt_by)
    absent = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return (
        many.join(hot, list(keys), "left")
        .withColumn(
            "_salt",
            F.when(absent, F.pmod(mixed, F.lit(NULL_SALTS)))
            .otherwise(F.coalesce(F.pmod(mixed, F.col("_ways")), F.lit(0)))
            .cast("int"),
        )
        .drop("_ways")
    )


def repeated(one: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat the row of each hot key once per salt, to meet ``spread`` rows."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_ways"), F.lit(1)) - 1)
    return (
        one.join(hot, list(keys), "left")
        .withColumn("_salt", F.explode(salts))
        .drop("_ways")
    )


def salted_lookup(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str],
    rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join of a large, perhaps skewed side to a side unique on ``keys``.

    The result is partitioned by key *and* salt: a later group-by on the key merges
    partial results instead of pulling the key into one task.
    """
    hot = hot_keys(many, keys, rows)
    return (
        spread(many, hot, keys, salt_by)
        .join(repeated(one, hot, keys), [*keys, "_salt"], "left")
        .drop("_salt")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """``out``: the sum of ``value`` over the key's earlier rows in ``order``, without one-task keys.

    Rows are range-partitioned by key and order and written once. Sums run inside each
    part; the sums of the key's earlier parts, one row per key and part, are added.
    NULL is a key like any other; no keys at all mean one order over all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, keys), *order]
    laid = checkpointed(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    cut = ["_part", *keys]
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*cut).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = laid.groupBy(*cut).agg(F.sum(value).alias("_sum"))
    names = [f"_cut{i}" for i in range(len(cut))]
    before = sums.select(
        *[F.col(c).alias(n) for c, n in zip(cut, names, strict=True)],
        F.coalesce(F.sum("_sum").over(earlier), zero).alias("_sum_before"),
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(cut, names, strict=True)])
    return (
        laid.withColumn("_inside", F.coalesce(F.sum(value).over(inside), zero))
        .join(before, same).withColumn(out, F.col("_inside") + F.col("_sum_before"))
        .drop("_part", "_inside", "_sum_before", *names)
    )


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows: int = HOT_ROWS
) -> DataFrame:
    """``row_number()`` per key in ``order``, 1-based, without one-task keys.

    Ordinary keys are numbered by one window. The rows of hot keys are range-partitioned
    by key and order, so a key is cut wherever its rows fill a task, be they all of one
    minute; positions inside a part get the counts of the key's earlier parts added.
    ``order`` must tell a key's rows apart, else which of the ties is first is open.
    """
    def plainly(part: DataFrame) -> DataFrame:
        return part.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))

    hot = hot_keys(df, keys, rows)
    if hot.isEmpty():
        return plainly(df)
    marked = df.join(hot, list(keys), "left")
    numbered = plainly(marked.where(F.col("_ways").isNull()).drop("_ways"))
    cut = running_sum(
        marked.where(F.col("_ways").isNotNull()).drop("_ways").withColumn("_one", F.lit(1).cast("bigint")),
        keys, [F.col(c) for c in order], "_one", "_before",
    )
    return numbered.unionByName(cut.withColumn(out, F.col("_before") + 1).drop("_one", "_before"))


def number_all(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """0-based position of every row in one total order, with no one-partition window.

    Range-partitioned, sorted inside partitions and written once; the counts of the
    earlier partitions (one row per partition) become offsets.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = checkpointed(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        # The low 33 bits are the position inside the partition.
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    offsets = (
        laid_out.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    # One row per partition, so its size is bounded by the partition count.
    return (
        laid_out.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_place") + F.col("_offset"))
        .drop("_part", "_place", "_offset")
    )
