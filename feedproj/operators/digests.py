"""Order-free digests by key range: drift is looked for only where two tables' digests differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.operators.canonical import EntitySpec
from feedproj.operators.capture import is_public
from feedproj.operators.ops import detect_drift
from feedproj.session import checkpointed

#: A leaf is a run of ``2 ** LEAF_BITS`` keys; each level above joins ``2 ** FAN_BITS`` ranges.
LEAF_BITS, FAN_BITS, LEVELS = 12, 6, 4
#: Up to this many stretches of keys are written into the scan's filter; beyond it rows are joined.
STRETCHES = 256


def range_digests(rows: DataFrame, key: str, content: Column, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """``leaf``, ``n``, ``total``, ``mixed`` of the rows of each run of keys.

    Sums and exclusive-ors of a row hash: no order, so tasks combine before they move, and
    digests of two disjoint sets of rows add up. A table small enough to keep beside its rows.
    """
    h = F.xxhash64(F.col(key), content)
    return rows.groupBy(F.shiftright(F.col(key), leaf_bits).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("total"), F.bit_xor(F.xxhash64(h)).alias("mixed"))


def source_digests(canonical: DataFrame, spec: EntitySpec, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """Digests of what the source shows: its public rows."""
    shown = canonical.where(is_public(F.col("status"))) if "status" in canonical.columns else canonical
    return range_digests(shown, spec.key, F.col("checksum"), leaf_bits)


def projection_digests(projection: DataFrame, spec: EntitySpec, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """Digests of what the projection shows: its live rows."""
    return range_digests(projection.where("deleted_at IS NULL"), spec.natural_key, F.col("checksum"), leaf_bits)


def differing_leaves(left: DataFrame, right: DataFrame, fan_bits: int = FAN_BITS, levels: int = LEVELS) -> DataFrame:
    """``leaf`` of the ranges whose digests differ, looked for from wide ranges down to leaves.

    Each level sums up only what lies in the ranges that differed one level above.
    """
    differ = None
    for level in range(levels - 1, -1, -1):
        bits = fan_bits * level
        sides = []
        for table in (left, right):
            if differ is not None:
                above = F.shiftright("leaf", bits + fan_bits).alias("_above")
                table = table.withColumn("_above", above).join(differ, "_above", "left_semi").drop("_above")
            sides.append(table.groupBy(F.shiftright("leaf", bits).alias("_range")).agg(
                F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed")))
        same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "total", "mixed")])
        differ = (
            sides[0].alias("a").join(sides[1].alias("b"), "_range", "full_outer").where(~same)
            .select(F.col("_range").alias("_above"))
        )
    return differ.select(F.col("_above").alias("leaf"))


def rows_in(rows: DataFrame, key: str, leaves: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """The rows of the leaves. A few stretches of keys become a filter of the scan, many a semi join."""
    found = sorted(r[0] for r in leaves.orderBy("leaf").limit(STRETCHES * 16).collect())
    stretches: list[list[int]] = []
    for leaf in found:
        if stretches and stretches[-1][1] == leaf:
            stretches[-1][1] = leaf + 1
        else:
            stretches.append([leaf, leaf + 1])
    if len(found) == STRETCHES * 16 or len(stretches) > STRETCHES:
        return rows.withColumn("leaf", F.shiftright(F.col(key), leaf_bits)).join(leaves, "leaf", "left_semi").drop("leaf")
    inside = [(F.col(key) >= a << leaf_bits) & (F.col(key) < b << leaf_bits) for a, b in stretches]
    return rows.where(reduce(Column.__or__, inside, F.lit(False)))


def detect_drift_ranges(
    canonical: DataFrame, projection: DataFrame, spec: EntitySpec, source: DataFrame | None = None,
    stored: tuple[DataFrame, DataFrame] | None = None, leaf_bits: int = LEAF_BITS,
) -> DataFrame:
    """The rows of :func:`ops.detect_drift`, with rows compared only in key ranges that differ.

    ``stored``: digests of source and projection kept from when they were written; without
    them both tables are digested first. Keys that show nothing on either side have no
    drift, so digests of what is shown decide.
    """
    left, right = stored or (source_digests(canonical, spec, leaf_bits), projection_digests(projection, spec, leaf_bits))
    leaves = checkpointed(differing_leaves(left, right))
    raw = None if source is None else rows_in(source, source.columns[0], leaves, leaf_bits)
    return detect_drift(
        rows_in(canonical, spec.key, leaves, leaf_bits), rows_in(projection, spec.natural_key, leaves, leaf_bits), spec, raw)
