"""Embedding near-dedup by lattice hashing: E8 cells in several tables, cosine verified."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import Groups, components, small_batches, to_batch
from feedproj.session import checkpointed

LEAST_COSINE = 0.93
TABLES = 8
#: Lattice points per cell: each decodes eight projections.
BLOCKS = 2
#: Size of a lattice cell against the projections of a unit vector, whose deviation is 1.
WIDTH = 1.75
#: Neighbouring cells probed in each table.
PROBES = 4
#: Vectors of a cell compared in one piece; larger cells are cut into pieces that meet in pairs.
PIECE = 512


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to a cell's neighbours."""
    pairs = [
        [a if k == i else b if k == j else 0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)
    ]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + [list(s) for s in halves])


def _even(x: np.ndarray) -> np.ndarray:
    """The closest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(-1)
    rows = np.arange(len(x))
    odd = near.sum(-1) % 2 != 0
    near[rows[odd], worst[odd]] += np.where(off[rows[odd], worst[odd]] >= 0, 1, -1)
    return near


def closest(x: np.ndarray) -> np.ndarray:
    """The closest E8 points: integers with an even sum, or the same shifted by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(-1) < ((x - whole) ** 2).sum(-1)
    return np.where(nearer[:, None], half, whole)


class Lattice:
    def __init__(self, size: int, tables: int = TABLES, blocks: int = BLOCKS, width: float = WIDTH, probes: int = PROBES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(tables, size, 8 * blocks)) / width
        self.mixers = rng.integers(1, 1 << 62, size=(tables, 8 * blocks), dtype=np.int64) | 1
        self.probes, self.roots = probes, roots()

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell hashes, vectors x tables x (1 + probes): the own cell, then its neighbours nearest the vector."""
        n = len(unit)
        out = np.empty((n, len(self.planes), 1 + self.probes), np.int64)
        steps = (2 * self.roots).astype(np.int64)
        for t, planes in enumerate(self.planes):
            at = (unit @ planes).reshape(-1, 8)
            point = closest(at)
            toward = ((at - point) @ self.roots.T).reshape(n, -1)  # the larger, the nearer that neighbour
            doubled = (2 * point).astype(np.int64).reshape(n, -1)
            with np.errstate(over="ignore"):
                own = (doubled * self.mixers[t]).sum(1)
                delta = (steps[None] * self.mixers[t].reshape(-1, 1, 8)).sum(2).reshape(-1)
                out[:, t, 0] = own
                if self.probes:
                    best = np.argsort(-toward, 1, kind="stable")[:, : self.probes]
                    out[:, t, 1:] = own[:, None] + delta[best]
        return out


def classes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Every row with ``vec_id``, ``label`` and, if it can link, the hashes of its class of equal vectors."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("vector"))
    size = F.aggregate("vector", F.lit(0.0), lambda t, x: F.greatest(t, F.abs(x)))
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (size > 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        F.lit(False),
    )
    return rows.withColumns({
        "class_1": F.when(fine, F.xxhash64("label", "vector")),
        "class_2": F.when(fine, F.xxhash64(F.lit("vector"), "vector", "label")),
    })


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows that share the first column's value; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether a pair's first shared table, and the lesser shared cell there, is this one.

    ``a``, ``b``: cells of each pair's vectors, pairs x tables x cells. A cell is shared if it
    is the own cell of one and the own or a probed cell of the other. So each pair counts once.
    """
    here, there = (a[:, :, :1] == b).any(2), (b[:, :, :1] == a).any(2)
    t = (here | there).argmax(1)
    n = np.arange(len(a))
    last = np.iinfo(np.int64).max
    lesser = np.minimum(np.where(here[n, t], a[n, t, 0], last), np.where(there[n, t], b[n, t, 0], last))
    return (t == table) & (lesser == cell)


def cell_links(run: pa.Table, tables: int, least: float):
    """The links of one cell (or of two pieces of it): member ids, weights of links, group names."""
    vec = matrix(run.column("vector"))
    cells = matrix(run.column("cells")).reshape(len(vec), tables, -1)
    table, cell = run.column("table")[0].as_py(), run.column("cell")[0].as_py()
    low, high = run.column("low")[0].as_py(), run.column("high")[0].as_py()
    piece, weight = run.column("piece").to_numpy(), run.column("copies").to_numpy()
    ids, own = run.column("rep").to_numpy(), cells[:, table, 0] == cell
    unit = vec / np.abs(vec).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    near = np.triu(unit @ unit.T >= least, 1) & (own[:, None] | own[None])
    if low != high:
        near &= piece[:, None] != piece[None]
    i, j = np.nonzero(near)
    fresh = np.concatenate([np.zeros(0, bool), *(
        first_meeting(cells[i[k : k + 20_000]], cells[j[k : k + 20_000]], table, cell) for k in range(0, len(i), 20_000)
    )])
    i, j = i[fresh], j[fresh]
    counts = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    groups = Groups()
    for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
        groups.join(a, b)
    return [(x, int(counts[k]), groups.find(x)) for k, x in enumerate(ids.tolist()) if counts[k]]


def dedup(
    vectors: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, blocks: int = BLOCKS,
    width: float = WIDTH, probes: int = PROBES, piece: int = PIECE,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Vectors are compared if their labels and sizes are equal. Equal vectors are one class,
    which stands in the index once and counts as often as it occurs. Each class lies in its
    own cell and in the ``probes`` neighbouring cells of every table; pairs that share a cell
    which is one's own are verified by cosine in double precision, in the first cell where
    they meet, and only counts and group names leave the task. A cell of more than ``piece``
    classes is cut into pieces that meet in pairs, so no task holds a whole large cell.

    Rows with a NULL id or label, or whose vector is NULL, empty, zero or holds NULL or
    non-finite numbers, link with nothing. Repeated rows link with each other.
    """
    small_batches(vectors.sparkSession)
    rows = classes(vectors, key, vector, label)
    reps = rows.where("class_1 is not null").groupBy("class_1", "class_2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    ddl = "class_1 bigint, class_2 bigint, rep bigint, copies bigint, scope bigint, vector array<double>, cells array<bigint>"
    names = ["class_1", "class_2", "rep", "copies", "scope"]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("vector", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, Lattice] = {}
        for batch in batches:
            said = batch.column(5).to_pylist()
            cells: list = [None] * len(said)
            for size in {len(x) for x in said}:
                at = [k for k, x in enumerate(said) if len(x) == size]
                part = np.array([said[k] for k in at])
                part /= np.abs(part).max(1, keepdims=True)
                part /= np.sqrt((part * part).sum(1, keepdims=True))
                grid = by_size.setdefault(size, Lattice(size, tables, blocks, width, probes))
                for k, c in zip(at, grid.cells(part).reshape(len(at), -1), strict=True):
                    cells[k] = c
            yield to_batch(schema, [*(batch.column(k) for k in range(6)), pa.array(cells, pa.list_(pa.int64()))])

    scope = F.xxhash64("label", F.size("vector")).alias("scope")
    reps = checkpointed(reps.select("class_1", "class_2", "rep", "copies", scope, "vector").mapInArrow(hashed, ddl))
    every = F.posexplode("cells").alias("slot", "cell")
    at = reps.select("class_1", "class_2", "scope", every).select(
        "class_1", "class_2", "scope", "cell",
        (F.col("slot") / (1 + probes)).cast("int").alias("table"), (F.col("slot") % (1 + probes) == 0).alias("own"),
    )
    place = ["scope", "table", "cell"]
    busy = at.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).where("n > 1 and owned").select(
        *place, F.ceil(F.col("n") / piece).cast("int").alias("pieces")
    )
    mine = F.pmod(F.xxhash64("class_1", "class_2"), F.col("pieces")).cast("int")
    meet = at.join(busy, place).withColumn("piece", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    meet = meet.withColumns({"low": F.least("piece", "other"), "high": F.greatest("piece", "other")})
    full = meet.join(reps.drop("scope"), ["class_1", "class_2"]).select(
        F.xxhash64(*place, "low", "high").alias("bucket"), "table", "cell", "low", "high", "piece", "rep", "copies", "vector", "cells", "scope"
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("lead", pa.int64())])
        for run in runs_of(batches):
            if len(run) > 1 and (found := cell_links(run, tables, least)):
                yield to_batch(out, list(zip(*found, strict=True)))

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = checkpointed(
        full.repartition(parts, "bucket").sortWithinPartitions("bucket", "rep").mapInArrow(verified, "rep bigint, links bigint, lead bigint")
    )
    lead = components(links.select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    of_rep = links.groupBy("rep").agg(F.sum("links").alias("links")).join(
        lead.withColumnRenamed("id", "rep"), "rep", "left"
    )
    of_class = reps.select("class_1", "class_2", "rep", "copies").join(of_rep, "rep", "left").select(
        "class_1", "class_2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("lead")
    )
    return rows.drop("vector", "label").join(of_class, ["class_1", "class_2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("lead", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("lead", "vec_id"), F.lit(True)).alias("kept"),
    )
