"""Read layouts: rows clustered by several columns at once, files that answer equality lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

#: Each column is cut into ``2 ** BITS`` ranges of about equally many rows.
BITS = 4
#: How many first bytes of a string tell its range.
FIRST = 6


def _number(df: DataFrame, name: str) -> Column:
    """A number in the column's order; of a string its first bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, StringType):
        first = F.rpad(F.hex(F.substring(F.encode(F.col(name), "UTF-8"), 1, FIRST)), 2 * FIRST, "0")
        return F.conv(first, 16, 10).cast("bigint").cast("double")
    return F.unix_micros(F.col(name).cast("timestamp")).cast("double")


def _above(df: DataFrame, name: str, border: float) -> Column:
    """Whether the column's number is above a border; strings are compared as bytes, without making the number."""
    if isinstance(df.schema[name].dataType, StringType):
        return F.substring(F.col(name).cast("binary"), 1, FIRST) > F.lit(bytearray(int(border).to_bytes(FIRST, "big")))
    return _number(df, name) > F.lit(border)


def _place(df: DataFrame, name: str, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted ``cuts`` the column is above, from ``first`` on, by halves; NULL is above none."""
    if not cuts:
        return F.lit(first).cast("bigint")
    half = len(cuts) // 2
    return F.when(_above(df, name, cuts[half]), _place(df, name, cuts[half + 1:], first + half + 1)).otherwise(
        _place(df, name, cuts[:half], first))


def interleaved(df: DataFrame, by: Sequence[str], bits: int = BITS) -> Column:
    """A number whose bits are the columns' ranges in turn, so near rows are near in every column.

    The ranges' borders come from one pass of approximate percentiles: ``2 ** bits - 1``
    numbers for each column. NULL is in the first range.
    """
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    borders = df.agg(*[F.percentile_approx(_number(df, c), shares, 10_000).alias(c) for c in by]).first()
    out = F.lit(0).cast("bigint")
    for j, name in enumerate(by):
        place = _place(df, name, sorted(set(borders[name] or [])))
        for i in range(bits):
            bit = F.shiftright(place, i).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, i * len(by) + j))
    return out


def write_clustered(
    df: DataFrame, path: str, by: Sequence[str], lookups: Mapping[str, int] | None = None, files: int | None = None,
    bits: int = BITS,
) -> None:
    """A parquet table for listings and lookups.

    Rows are range-partitioned and sorted by the interleaved order of ``by``, so a filter on
    any of these columns skips files and row groups by their least and greatest values.
    ``lookups`` names columns that are looked up by equality (a slug, a link's target) and
    about how many distinct values a file holds: their parquet bloom filters skip whatever
    does not hold the value. ``files``: how many; by default the shuffle's partitions.
    """
    parts = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_z", interleaved(df, by, bits))
    laid = placed.repartitionByRange(parts, "_z", *by).sortWithinPartitions("_z", *by).drop("_z")
    writer = laid.write.mode("overwrite")
    for name, distinct in (lookups or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{name}", str(distinct))
    writer.parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """How many rows the scans of a query hand on before its filters: what was not skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollectPublic()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
