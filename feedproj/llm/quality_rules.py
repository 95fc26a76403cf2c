"""Quality rules by host: failures by domain, shrunk by an empirical beta prior, decide documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import SPACES, row_key, texts, to_batch, unpacked, whole_rows
from feedproj.session import checkpointed

FEWEST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A host is bad if its shrunk failure rate is above this.
BAD_HOST_RATE = 0.5
#: Strength of the prior, in documents: least (hosts that differ wildly) and most (hosts that are alike).
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
#: Distinct words a worker remembers before it starts anew.
WORDS = 1_000_000


class WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        sums = np.zeros(n, np.uint64)
        for k in range(window):
            sums = sums * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.sort(sums)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Equal sums are only a hint: name the windows exactly, by pairs of half windows.
    names, width = ids.astype(np.int64), 1
    while width < window:
        left, right = names[:-width], names[width:]
        names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1]
        width *= 2
    twice = np.flatnonzero(np.bincount(names)[names] > 1)
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str, numbers: WordNumbers) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()
    if len(numbers) > WORDS:
        numbers.clear()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids),
    )


def measures(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its row key, id, host, counts and the outcome of each rule.

    A NULL or empty text has zero of everything and fails ``few_words``.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    ddl = "doc_id bigint, host string, row_1 bigint, row_2 bigint, " + ", ".join(f"{c} bigint" for c in counts)
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in ["row_1", "row_2", *counts])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            found = [measure(x, numbers) for x in batch.column(1).to_pylist()]
            yield to_batch(schema, [batch.column(k) for k in (0, 2, 3, 4)] + (list(zip(*found, strict=True)) if found else [[]] * 6))

    said = texts(docs, F.col(f"`{host}`").cast("string").alias("host"), *row_key(docs, key, text), key=key, text=text)
    n = F.col("n_words")
    rules = {
        "few_words": n < FEWEST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") > 20 * n) | (2 * n > F.col("word_chars")),
    }
    return said.mapInArrow(run, ddl).withColumns({f"fails_{k}": v for k, v in rules.items()}).withColumns({
        "base_failed": F.col("fails_few_words") | F.col("fails_repeats"),
        "any_failed": F.greatest(*[F.col(f"fails_{k}") for k in rules]),
    })


def host_verdicts(measured: DataFrame, bad_rate: float = BAD_HOST_RATE) -> DataFrame:
    """``host``, documents, failures, shrunk rate and ``host_bad`` of each host.

    The beta prior is fitted to the hosts' rates by moments: its mean is the corpus rate, its
    strength follows from how much more the rates differ than chance would make them. A host
    with few documents is drawn towards the corpus rate. NULL is no host. Rows are counted
    before the shuffle, so a host with a third of all rows is one row a task.
    """
    hosts = measured.where("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("any_failed").cast("bigint")).alias("host_failures")
    )
    rate = F.col("host_failures") / F.col("host_docs")
    k, total, failures, squares, over_n = hosts.agg(
        F.count(F.lit(1)), F.sum("host_docs"), F.sum("host_failures"),
        F.sum(F.col("host_docs") * rate * rate), F.sum(F.lit(1.0)),
    ).first()
    mean, strength = 0.0, MOST_STRENGTH
    if total:
        mean = failures / total
        chance = mean * (1 - mean)
        # E[sum n (p - mean)^2] = chance * hosts + between * (total - hosts), roughly.
        between = (squares - total * mean * mean - chance * over_n) / max(1.0, total - over_n)
        if k > 1 and chance > 0 and between > 0:
            strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, chance / between - 1))
    a, b = F.lit(mean * strength), F.lit((1 - mean) * strength)
    return hosts.withColumn("host_rate", (F.col("host_failures") + a) / (F.col("host_docs") + a + b)).withColumn(
        "host_bad", F.col("host_rate") > bad_rate
    )


def judge(docs: DataFrame, bad_rate: float = BAD_HOST_RATE, host: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures with the host's verdict and ``kept``: passes the base rules on a host that isn't bad.

    One row per input row. Documents without a host have no host verdict. The join sends
    counts, never texts, and both of its sides are plain exchanges, which Spark splits where
    one host holds much of the data.
    """
    measured = checkpointed(measures(docs, host, key, text))
    return measured.join(host_verdicts(measured, bad_rate), "host", "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_bad"), F.lit(False))
    )


def filtered(docs: DataFrame, bad_rate: float = BAD_HOST_RATE) -> DataFrame:
    """The documents that :func:`judge` keeps, all columns as they were."""
    keep = judge(docs, bad_rate).where("kept").select("row_1", "row_2").distinct()
    rows = docs.select(whole_rows(docs), *row_key(docs))
    return unpacked(rows.join(keep, ["row_1", "row_2"], "left_semi"), docs.columns)
