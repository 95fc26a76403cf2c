"""Mixing sources to target weights: blocks of tokens, drawn shard by shard through permutations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedproj.llm.common import running_sum, texts, to_batch
from feedproj.operators.skew import number_all
from feedproj.session import checkpointed

#: Words in a block; the last block of a source may hold fewer.
BLOCK = 256
#: Slots, of one block each, in an output shard.
SHARD = 1024
#: Fixed by the contract of op13: weights of the sources in turn, and the words shared out.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
SEED = 13
WORD = r"[^\x20\x09-\x0D]+"
#: Cells that the slots' draws are sorted into before they meet a source's interval.
CELLS = 65_536
ROUNDS = 4


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index, size, key, back: bool = False) -> np.ndarray:
    """Where ``index`` (0 to ``size`` - 1) goes in the pseudorandom order named by ``key``.

    A Feistel network over the next power of four, walked until the place is inside
    ``size``: one to one for any size, with no table of the order. ``back`` inverts it.
    """
    out, size, key = (np.array(x, np.uint64) for x in (index, size, key))
    half = np.maximum(1, (np.frexp((size - np.uint64(1)).astype(float))[1] + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    steps = range(ROUNDS)
    at = np.arange(len(out))
    while len(at):
        h, m, k = half[at], mask[at], key[at]
        left, right = out[at] >> h, out[at] & m
        for r in reversed(steps) if back else steps:
            if back:
                left, right = right ^ (_mixed(left, k + np.uint64(r)) & m), left
            else:
                left, right = right, left ^ (_mixed(right, k + np.uint64(r)) & m)
        out[at] = (left << h) | right
        at = at[out[at] >= size[at]]
    return out.astype(np.int64)


def order_key(source, epoch, seed: int) -> np.ndarray:
    """Names the order in which an epoch takes the blocks of a source."""
    source, epoch = (np.array(x, np.uint64) for x in (source, epoch))
    return _mixed(_mixed(source, np.full_like(source, seed)), epoch)


def sizes(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words), ``text_hash`` and ``row`` (unique) of each document, written once."""
    return checkpointed(
        texts(docs, F.col(f"`{source}`").cast("string").alias("source"), key=key, text=text).select(
            "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("size"),
            F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"),
        )
    )


def targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS
) -> DataFrame:
    """``source``, its number ``no`` (by code point, NULL last), ``source_size`` and ``target``.

    The shares of sources above ``most`` times their size stop there; each round one
    aggregate says what is left for the others, until no further source is above.
    """
    numbered = number_all(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").isNull(), F.col("source")], "no"
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    sources = checkpointed(numbered.withColumn("weight", weight))
    full: Column = F.lit(False)
    before = -1
    while True:
        row = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight"))),
            F.count(F.when(full, 1)),
        ).first()
        left, weighs = (row[0] or 0) * percent / 100 - (row[1] or 0), row[2] or 0
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(weighs or 1))
        if row[3] == before or not weighs:
            break
        before, full = row[3], F.col("source_size") * most < share
    capped = (F.col("source_size") * most).cast("double")
    return sources.select("no", "source", "source_size", F.when(full, capped).otherwise(share).alias("target"))


def quotas(sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``n_blocks``, ``slots`` (blocks the mix takes) and ``last_words`` (taken of the last one) of each source.

    Whole epochs first; the last epoch stops in the block where the target, rounded down, is
    reached. Where the short last block comes in that epoch is read from its permutation.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("no", "source_size", "n_blocks", "slots", "last_words")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, size, target = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            blocks = -(-size // block)
            target = np.floor(target).astype(np.int64)
            epochs, rest = np.divmod(target, np.maximum(size, 1))
            short = permute(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), order_key(no, epochs, seed), back=True)
            missing = blocks * block - size
            plain = -(-rest // block)
            late = plain > short
            slots = np.where(late, -(-(rest + missing) // block), plain)
            last = rest - ((slots - 1) * block - np.where(slots - 1 > short, missing, 0))
            # Without a part of an epoch the last slot takes all of its block.
            yield to_batch(schema, [no, size, blocks, epochs * blocks + slots, np.where(rest > 0, last, block)])

    return sources.select("no", "source_size", "target").mapInArrow(
        run, ", ".join(f"{f.name} bigint" for f in schema)
    )


def _owners(points: DataFrame, at: str, sources: DataFrame, first: str, size: str, keep: Sequence[str]) -> DataFrame:
    """Join each point to the source whose interval (from ``first``, ``size`` long) holds it.

    Intervals are cut at cells of equal width, so it is an equi-join on the cell whatever
    the number of sources, and a large source's points are spread over its cells.
    """
    total, n = sources.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1, total // max(CELLS, 4 * n))
    cells = F.sequence(F.floor(F.col(first) / width), F.floor((F.col(first) + F.col(size) - 1) / width))
    intervals = sources.where(F.col(size) > 0).select(*keep, F.col(first).alias("_lo"), F.col(size).alias("_size"), F.explode(cells).alias("_cell"))
    inside = (F.col(at) >= F.col("_lo")) & (F.col(at) < F.col("_lo") + F.col("_size"))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(intervals, "_cell").where(inside).drop("_cell", "_size")


def _scattered(index: Column, total: int, seed: int, df: DataFrame) -> DataFrame:
    """``df`` (shard, position) with ``at``: its index in a pseudorandom order of all."""
    schema = pa.schema([(n, pa.int64()) for n in ("shard", "position", "at")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).to_numpy(zero_copy_only=False)
            yield to_batch(schema, [batch.column(0), batch.column(1), permute(x, np.full(len(x), total), np.full(len(x), seed))])

    return df.select("shard", "position", index.alias("at")).mapInArrow(run, "shard bigint, position bigint, at bigint")


def draw(sources: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``shard``, ``position``, ``no`` and ``k`` (the source's k-th slot) of every slot of the mix.

    Each slot of a shard draws its source by a hash, with chances in the ratio of ``slots``:
    the shard's counts by source are one multinomial draw. Counts summed over the earlier
    shards number a source's slots. The few slots beyond a source's quota go, in a
    pseudorandom order, to the sources whose draws fell short, so totals are exact.
    """
    spark = sources.sparkSession
    sources = checkpointed(running_sum(sources, [], [F.col("no")], "slots", "first"))
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    wide = max(spark.sparkContext.defaultParallelism, total // 4_000_000)
    slots = spark.range(0, total, 1, wide).select(
        F.floor(F.col("id") / shard).alias("shard"), (F.col("id") % shard).alias("position"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))).alias("at"),
    )
    drawn = checkpointed(_owners(slots, "at", sources, "first", "slots", ["no"]).select("shard", "position", "no"))
    counts = checkpointed(drawn.groupBy("no", "shard").agg(F.count(F.lit(1)).alias("n")))
    earlier = running_sum(counts, ["no"], [F.col("shard")], "n", "earlier").select("no", "shard", "earlier")
    inside = F.row_number().over(W.partitionBy("no", "shard").orderBy("position")) - 1
    numbered = drawn.withColumn("inside", inside).join(earlier, ["no", "shard"]).withColumn("k", F.col("earlier") + F.col("inside"))
    got = sources.select("no", "slots").join(counts.groupBy("no").agg(F.sum("n").alias("drawn")), "no", "left").fillna(0, ["drawn"])
    spare, short = F.col("drawn") - F.col("slots"), F.col("slots") - F.col("drawn")
    got = got.withColumn("spare", F.greatest(spare, F.lit(0))).withColumn("short", F.greatest(short, F.lit(0)))
    got = running_sum(got, [], [F.col("no")], "spare", "spare_first")
    got = checkpointed(running_sum(got, [], [F.col("no")], "short", "short_first"))
    numbered = checkpointed(numbered.join(got.select("no", "slots", "spare_first"), "no"))
    vacant = int(got.agg(F.coalesce(F.sum("spare"), F.lit(0))).first()[0])
    free = _scattered(
        F.col("spare_first") + F.col("k") - F.col("slots"), max(vacant, 1), seed, numbered.where("k >= slots")
    )
    filled = _owners(free, "at", got, "short_first", "short", ["no", "drawn"]).select(
        "shard", "position", "no", (F.col("drawn") + F.col("at") - F.col("_lo")).alias("k")
    )
    return numbered.where("k < slots").select("shard", "position", "no", "k").union(filled)


def block_slots(slots: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``shard``, ``position``, ``no``, ``block`` and ``words`` (taken from its start) of every slot.

    The k-th slot of a source is in epoch ``k / n_blocks``; each epoch takes every block once,
    in a pseudorandom order of its own.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("shard", "position", "no", "block", "words")])
    columns = ["shard", "position", "no", "k", "source_size", "n_blocks", "slots", "last_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, place, no, k, size, blocks, count, last = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            epoch, index = np.divmod(k, np.maximum(blocks, 1))
            at = permute(index, blocks, order_key(no, epoch, seed))
            words = np.where(at == blocks - 1, size - at * block, block)
            yield to_batch(schema, [shard, place, no, at, np.where(k == count - 1, np.minimum(last, words), words)])

    return slots.join(sources, "no").select(*columns).mapInArrow(run, ", ".join(f"{f.name} bigint" for f in schema))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS,
    block: int = BLOCK, shard: int = SHARD, seed: int = SEED,
    source: str = "source", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The mix as spans of documents: which words of which document stand in which slot.

    One row for each stretch of a document inside a block and each slot that takes words of
    it: ``row`` (unique for each input row), ``doc_id``, ``size`` (words), ``source_size``,
    ``target``, ``shard``, ``position``, ``offset`` (the words' place in the slot), ``first``
    (first word taken, from 0) and ``words``. A stretch that isn't taken has one row with NULL
    slots and 0 words, as has a document without words, so every input row is there.

    A source's documents stand end to end by id, cut into blocks of ``block`` words. Sources
    are taken to within one word of their targets, each block at most ``most`` times. Only
    words' counts move, never texts. NULL sources are one source, the last; NULL ids come
    first in theirs; NULL and empty texts have no words; repeated rows are further
    documents. Equal input gives equal rows. Other columns are ignored; an empty table
    gives no rows. The number of sources has no bound: their rows are never collected.
    """
    sized = sizes(docs, source, key, text)
    sources = checkpointed(targets(sized, weights, percent, most))
    parts = checkpointed(quotas(sources, block, seed))
    taken = block_slots(draw(parts, shard, seed), parts, block, seed)
    placed = sized.withColumnRenamed("source", "s").join(sources.withColumnRenamed("source", "t"), F.expr("s <=> t")).drop("s", "t")
    placed = running_sum(placed, ["no"], [F.col("doc_id"), F.col("text_hash"), F.col("row")], "size", "start")
    until = F.col("start") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((until - 1) / block)))
    stretches = placed.withColumn("block", F.explode_outer(blocks))
    begin = F.col("block") * block
    stretches = stretches.withColumn("lo", F.greatest(F.col("start") - begin, F.lit(0))).withColumn("hi", F.least(until - begin, F.lit(block)))
    met = stretches.alias("a").join(
        taken.alias("b"),
        (F.col("a.no") == F.col("b.no")) & (F.col("a.block") == F.col("b.block")) & (F.col("b.words") > F.col("a.lo")), "left",
    )
    used = F.col("shard").isNotNull()
    return met.select(
        "row", "doc_id", "size", "source_size", "target", "shard", "position",
        F.when(used, F.col("lo")).alias("offset"),
        F.when(used, F.col("a.block") * block + F.col("lo") - F.col("start")).alias("first"),
        F.when(used, F.least("hi", "b.words") - F.col("lo")).otherwise(0).alias("words"),
    )


def taken_words(mixed: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) of each document."""
    return (
        mixed.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("words").cast("bigint").alias("taken")).drop("row")
    )
