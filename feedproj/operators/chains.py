"""Parent chains: causation of events, page trees.

Pointer doubling: every round joins each open row to its current ancestor and
takes over that ancestor's ancestor, so a chain of depth d is done after about
log2(d) rounds. Each round is one join on a unique key and is staged, so neither
the plan nor the lineage grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.operators.skew import HOT_ROWS, number_within, salted_lookup
from feedproj.session import Staging, checkpointed


def resolve_chains(
    nodes: DataFrame, key: str, parent: str, label: str | None = None, separator: str = "/",
    rows: int = HOT_ROWS, paths: bool = True,
) -> DataFrame:
    """``key, root, depth, state`` and, with ``paths``, ``path`` for every row of ``nodes`` (unique on ``key``).

    A NULL parent is a root. ``state`` is ``ok``, ``orphan`` (the chain ends in a
    parent that does not exist; ``root`` is that missing key's child) or ``cycle``
    (root, depth and path NULL). Rounds carry keys and counts only. Paths, the labels
    from the root down, are made afterwards and not for rows that run into a cycle.
    """
    steps = Staging(nodes.sparkSession)
    try:
        closed = _closed(steps, nodes.select(F.col(key).alias("k"), F.col(parent).alias("_p")), {}, rows)
        ends = closed.select(
            F.col("k").alias(key), "root", "depth",
            F.when(F.col("lost"), "orphan").otherwise("ok").alias("state"))
        if paths:
            # Only rows whose chain ends; a chain's rows all end if one of them does.
            labels = nodes.join(ends.select(key), key, "left_semi").select(
                F.col(key).alias("k"), F.col(parent).alias("_p"), F.col(label or key).cast("string").alias("path"))
            joined = {"path": lambda above, own: F.concat(above, F.lit(separator), own)}
            named = _closed(steps, labels, joined, rows).select(F.col("k").alias(key), "path")
            ends = ends.join(named, key)
        circles = nodes.select(key).join(closed.select(F.col("k").alias(key)), key, "left_anti").select(
            key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in ends.schema if f.name not in (key, "state")],
            F.lit("cycle").alias("state"))
        return checkpointed(ends.unionByName(circles))
    finally:
        steps.clear()


def _closed(steps: Staging, nodes: DataFrame, carried: dict[str, Callable[[Column, Column], Column]], rows: int) -> DataFrame:
    """``k, root, depth, lost`` of the rows (``k``, parent ``_p``) whose chain ends, and what is ``carried``.

    ``carried`` says of each further column how an ancestor's value and the row's own join.
    """
    ids = nodes.select(F.col("k").alias("_p"), F.lit(True).alias("_there"))
    linked = salted_lookup(nodes, ids, ["_p"], ["k"], rows)
    there = F.col("_there")
    # ``up``: nearest ancestor not yet taken over; NULL once the chain is closed.
    walk = steps(linked.select(
        "k", *carried,
        F.when(there, F.col("_p")).alias("up"),
        F.when(there, F.col("_p")).otherwise(F.col("k")).alias("root"),
        F.when(there, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("depth"),
        (F.col("_p").isNotNull() & there.isNull()).alias("lost"),
    ))
    still = walk.where("up IS NOT NULL")
    finished, open_rows = [walk.where("up IS NULL")], still.count()
    while open_rows:
        ancestors = walk.select(F.col("k").alias("up"), *[
            F.col(c).alias(f"_{c}") for c in ("up", "root", "depth", "lost", *carried)])
        stepped = steps(salted_lookup(still, ancestors, ["up"], ["k"], rows).select(
            "k", *[join(F.col(f"_{c}"), F.col(c)).alias(c) for c, join in carried.items()],
            F.col("_up").alias("up"),
            F.col("_root").alias("root"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
            F.col("_lost").alias("lost"),
        ))
        still = stepped.where("up IS NOT NULL")
        finished.append(stepped.where("up IS NULL"))
        walk = _union([*finished, still])
        left = still.count()
        if left == open_rows:
            # No chain closed in a whole round: what is open runs in circles.
            break
        open_rows = left
    return _union(finished).select("k", "root", "depth", "lost", *carried)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def page_tree(pages: DataFrame, key: str = "source_post_id", rows: int = HOT_ROWS) -> DataFrame:
    """Pages with ``uri``, ``depth``, ``tree_state`` and ``position`` among siblings.

    Parent 0 is the top. Siblings are ordered by (menu_order, id).
    """
    tops = pages.withColumn("_parent", F.when(F.col("parent_id") != 0, F.col("parent_id")))
    chain = resolve_chains(tops.select(key, "_parent", "slug"), key, "_parent", "slug", rows=rows).select(
        key, F.concat(F.lit("/"), "path").alias("uri"), "depth", F.col("state").alias("tree_state"))
    placed = number_within(pages, ["parent_id"], ["menu_order", key], "position", rows)
    return placed.join(chain, key)


def trace(events: DataFrame, correlation_id: str) -> DataFrame:
    """Events of one business transaction, in causal order of capture."""
    return events.where(F.col("correlation_id") == correlation_id).orderBy("created_at", "id")


def causation_chains(events: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """Every event with its root event, depth below it, and state of its chain."""
    return resolve_chains(events.select("id", "causation_id"), "id", "causation_id", rows=rows, paths=False).select(
        "id", F.col("root").alias("root_id"), "depth", "state")


def transactions(events: DataFrame) -> DataFrame:
    """One row per correlation id: how many events, when, and the aggregates touched."""
    return events.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.count(F.when(F.col("causation_id").isNull(), 1)).alias("n_roots"),
    )
