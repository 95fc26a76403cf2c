"""Row keys, Arrow helpers and link components shared by the operators."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedproj.session import checkpointed

#: White space of the word and line rules: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
#: Links up to this many are joined in one task; more take the distributed rounds.
LINKS_IN_ONE_TASK = 1_000_000
#: Rows an Arrow batch holds at most, so long texts don't add up in a worker.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts takes in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker and kept for its later tasks.

    Functions travel with the job and are loaded anew in every task, so what a worker should
    remember (a loaded tokenizer, words already encoded) is kept on a module of its own.
    """
    store = sys.modules.setdefault("_feedproj_kept", types.ModuleType("_feedproj_kept"))
    if name not in vars(store):
        setattr(store, name, make())
    return getattr(store, name)


def one_thread_each() -> None:
    """A task has one core: the tokenizers library starts no threads of its own in its worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


class Aged:
    """A bounded memory of texts' encodings: two halves, of which the older is forgotten when the newer is full."""

    def __init__(self, limit: int):
        #: Bytes that keys and values of one half may take.
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def learn(self, keys: Iterable[str], encode: Callable[[list[str]], Iterable[bytes]]) -> dict[str, bytes]:
        """The memory with all of ``keys`` in it; those it doesn't know are encoded together."""
        new, old = self.new, self.old
        missing = [k for k in keys if k not in new]
        if self.size > self.limit and missing:
            self.old, self.new, self.size = new, {}, 0
            new, old = self.new, self.old
            missing = list(keys)
        known = [k for k in missing if k in old]
        unknown = sorted(k for k in missing if k not in old)
        for names, values in ((known, [old[k] for k in known]), (unknown, list(encode(unknown)) if unknown else [])):
            new.update(zip(names, values, strict=True))
            # 200: what Python adds to a string and to bytes, and a place in the table.
            self.size += sum(map(len, names)) + sum(map(len, values)) + 200 * len(names)
        return new


def by_bytes(said: Sequence[str], limit: int) -> Iterator[list[str]]:
    """The texts in runs of at most ``limit`` characters, or of one longer text."""
    part: list[str] = []
    size = 0
    for x in said:
        if part and size + len(x) > limit:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def texts(docs: DataFrame, *more: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` (NULL: empty) of the documents, whatever other columns there are."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def row_key(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that name a row by its id and text: equal for repeated rows, never NULL."""
    a, b = F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")
    return [F.xxhash64(a, b).alias("row_1"), F.xxhash64(F.lit("row"), b, a).alias("row_2")]


def whole_rows(docs: DataFrame) -> Column:
    """All columns in one struct, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def unpacked(df: DataFrame, columns: Iterable[str], struct: str = "row", **changed: Column) -> DataFrame:
    """The columns packed by :func:`whole_rows`, with some replaced."""
    return df.select(*[
        (changed[c] if c in changed else F.col(f"{struct}.`{c}`")).alias(c) for c in columns
    ])


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def lists(values: np.ndarray, sizes: Iterable[int]) -> pa.ListArray:
    """A list column from its flat values and the size of each list."""
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


class Groups:
    """Disjoint sets of integers whose name is their smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        top = x
        while (over := up.get(top, top)) != top:
            top = over
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """Unite; whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        self.up.setdefault(low, low)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = Groups()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            groups.join(a, b)
    nodes = list(groups.up)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_pydict({
            "id": pa.array(part, pa.int64()),
            "component_id": pa.array([groups.find(x) for x in part], pa.int64()),
        })


def components(links: DataFrame, one_task: int = LINKS_IN_ONE_TASK) -> DataFrame:
    """``id``, ``component_id`` (smallest id reachable) of every id in the links ``a``, ``b``.

    A bounded number of links is joined in one task. Beyond it the links are rewired in
    rounds: every node sends its larger neighbours to its smallest one (large star), then
    its smaller ones (small star), until the links are stars. Each round is a group-by and
    a join, written to the shared folder, so neither lineage nor state grows.
    """
    edges = checkpointed(
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    before = _sign(edges)
    if before[0] <= one_task:
        return edges.coalesce(1).mapInArrow(_stars, "id bigint, component_id bigint")
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        now = _sign(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component_id")).union(
        edges.select("a", "a").distinct()
    )


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")),
    ).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        around.where("b > a").join(least, "a")
        .select(F.col("m").alias("a"), "b").where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b")
    return (
        moved.select(F.col("m").alias("a"), F.col("a").alias("b"))
        .union(moved.select(F.col("m").alias("a"), "b"))
        .where("a <> b").distinct()
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the key's earlier rows in ``order``, without one-task keys.

    Rows are range-partitioned by key and order and written once. Sums run inside each part;
    the sums of the key's earlier parts, one row per key and part, are added. ``keys`` must
    not be NULL; none at all means one order over all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, keys), *order]
    laid = checkpointed(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    cut = ["_part", *keys]
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*cut).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = laid.groupBy(*cut).agg(F.sum(value).alias("_sum"))
    before = sums.select(*cut, F.coalesce(F.sum("_sum").over(earlier), zero).alias("_before"))
    return (
        laid.withColumn("_inside", F.coalesce(F.sum(value).over(inside), zero))
        .join(before, cut).withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_part", "_inside", "_before")
    )
