"""Several listings as one document, and one batch to several targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedproj.session import checkpointed


def compose(parts: dict[str, tuple[DataFrame, list[Column], list[str]]]) -> DataFrame:
    """One row ``document`` of named lists.

    ``parts``: name to (frame of one listing page, its order, columns shown). Every
    part is limited by its listing (at most 201 rows), so one row holds them all.
    """
    lists = []
    for name, (rows, order, shown) in parts.items():
        ranked = rows.withColumn("_json", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}))
        placed = ranked.withColumn("_n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))
        lists.append(placed.agg(F.sort_array(F.collect_list(F.struct("_n", "_json"))).alias("_rows")).select(
            F.concat(F.lit(f'"{name}":['), F.array_join(F.transform("_rows", lambda r: r["_json"]), ","),
                     F.lit("]")).alias("part")))
    first, *rest = lists
    return first.select(
        F.concat(F.lit("{"), F.concat_ws(",", F.col("part"), *[p.scalar() for p in rest]), F.lit("}"))
        .alias("document"))


def fan_out(canonical: DataFrame, targets: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Deliver one canonical frame to several targets; a failing one harms no other.

    The frame is written once and every target reads that copy. Returns
    ``delivered`` or the error text per target.
    """
    shared = checkpointed(canonical)
    outcome = {}
    for name, deliver in targets.items():
        try:
            deliver(shared)
            outcome[name] = "delivered"
        except Exception as problem:  # the report is the result
            outcome[name] = f"failed: {type(problem).__name__}: {problem}"
    return outcome
