"""Importance resampling towards a target text: array-scored weights, a cutoff found by counting."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import texts, to_batch
from feedproj.operators.skew import number_all
from feedproj.session import checkpointed

# Fixed by the contract of op12.
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"
# End of fixed values.
#: Bytes of text whose words a worker handles at once (at least one text).
CHUNK = 4_000_000
#: Words up to this many bytes are appended to a checksum by table, longer ones one by one.
SHORT = 48
#: Thresholds counted in one job.
WAYS = 15

#: Letters lower-cased (A-Z only); whatever is no digit, letter or byte of a further character is a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _one_byte() -> np.ndarray:
    """What a zero byte does to a crc32, by its last byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


ONE_BYTE = _one_byte()


def _joined_crcs(crc: np.ndarray, added: np.ndarray, size: np.ndarray, said: list[bytes], which: np.ndarray) -> np.ndarray:
    """crc32 of each word, a space and a second word (number ``which`` of ``said``).

    ``crc`` is the first word's, ``added`` and ``size`` are of the space and the second word:
    the first is moved on by so many zero bytes and the second laid over it.
    """
    out = crc.copy()
    order = np.argsort(-size, kind="stable")
    long = int((size > SHORT).sum())
    short, moved = order[long:], crc[order[long:]]
    sizes = size[short]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # those with more than k bytes
        moved[:n] = (moved[:n] >> np.uint32(8)) ^ ONE_BYTE[moved[:n] & np.uint32(255)]
    out[short] = moved ^ added[short]
    for i in order[:long]:
        out[i] = zlib.crc32(b" " + said[which[i]], int(crc[i]))
    return out


def features(said: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the texts (UTF-8), and the text each belongs to."""
    words = [x.translate(WORD_BYTES).split() for x in said]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    distinct = list(dict.fromkeys(flat))
    number = {w: i for i, w in enumerate(distinct)}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))[ids]
    after = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))
    length = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
    text = np.repeat(np.arange(len(said)), sizes)
    pair = np.flatnonzero(text[1:] == text[:-1])
    second = ids[pair + 1]
    two = _joined_crcs(alone[pair], after[second], length[second], distinct, second)
    return np.concatenate([alone, two]) % np.uint32(buckets), np.concatenate([text, text[pair]])


def chunks(said: Iterable[bytes], limit: int = CHUNK) -> Iterator[list[bytes]]:
    part, size = [], 0
    for x in said:
        if part and size + len(x) > limit:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket. Of each task only counts by bucket leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch.column(1).cast(pa.binary()).to_pylist()):
                total += np.bincount(features(part, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for row in texts(docs, key=key, text=text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[row[0]] = row[1]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed share in the target and in the source, floored."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_features`` and ``weight``: the floored mean of its features' gains, 0 without any."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, weights = [], []
            for part in chunks(batch.column(1).cast(pa.binary()).to_pylist()):
                bucket, of = features(part, len(gain))
                n = np.bincount(of, minlength=len(part))
                total = np.zeros(len(part), np.int64)
                np.add.at(total, of, gain[bucket])
                counts.append(n)
                weights.append(total // np.maximum(n, 1))
            if counts:
                yield to_batch(schema, [batch.column(0), np.concatenate(counts), np.concatenate(weights)])

    return texts(docs, key=key, text=text).mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: str = SEED) -> Column:
    """1000 times a Gumbel variate that follows from the seed and the id (NULL: no digits), floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def least_value(df: DataFrame, column: str, nth: int) -> tuple[int, int]:
    """The least value with at least ``nth`` rows up to it, and how many rows are below it.

    Every job counts, exactly, the rows up to each of a few thresholds and keeps the
    interval in which the ``nth`` row falls; no row leaves its task.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        cuts = sorted({low + (high - low) * k // (WAYS + 1) for k in range(1, WAYS + 1)})
        upto = df.agg(*[F.count(F.when(F.col(column) <= c, 1)) for c in cuts]).first()
        reached = [c for c, n in zip(cuts, upto, strict=True) if n >= nth]
        missed = [c for c, n in zip(cuts, upto, strict=True) if n < nth]
        if reached:
            high = reached[0]
        if missed:
            low = missed[-1] + 1
    return low, df.where(F.col(column) < low).count()


def best_rows(df: DataFrame, order: list[str], n: int) -> Column:
    """Whether a row is one of the ``n`` least by the integer columns of ``order``, the last of them unique."""
    if n <= 0:
        return F.lit(False)
    here, parts = df, []
    same: Column = F.lit(True)
    for column in order:
        value, below = least_value(here, column, n)
        parts.append(same & (F.col(column) < value))
        same = same & (F.col(column) == value)
        here, n = here.where(F.col(column) == value), n - below
    chosen = same
    for part in parts:
        chosen = chosen | part
    return chosen


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
    seed: str = SEED, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text",
) -> DataFrame:
    """Every document's ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (NULL: not drawn).

    Features are words and pairs of consecutive words, hashed into ``buckets``; both tables'
    counts are gathered by bucket over whole texts and all rows. Adding a Gumbel variate to a
    document's log weight and taking the highest is a draw without replacement by weight.
    Drawn are ``percent`` of the documents with at least ``least_words`` words, rounded down,
    highest score first, ties to the smaller id. Rows with the same id and score are told
    apart by their place in the written scores, so repeated rows are drawn one by one. NULL
    ids come last among ties. NULL and empty texts have no features, weight 0 and are never
    drawn. An empty target or table of documents only smooths the shares; further columns are
    ignored.
    """
    gain = gains(bucket_counts(docs, buckets, key, text), bucket_counts(target, buckets, target_key, target_text))
    scored = checkpointed(
        weigh(docs, gain, key, text).select(
            "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
        ).withColumn("down", -F.col("score"))
        .withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("row", F.monotonically_increasing_id())
    )
    # w words have w - 1 pairs.
    open_ = scored.where(F.col("n_features") >= 2 * least_words - 1)
    order = ["down", "id", "row"]
    chosen = (F.col("n_features") >= 2 * least_words - 1) & best_rows(open_, order, percent * open_.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = number_all(scored.where(chosen), [F.col(c) for c in order], "place")
    return ranked.select(*columns, (F.col("place") + 1).alias("rank")).union(
        scored.where(~chosen).select(*columns, F.lit(None).cast("bigint"))
    )
