"""Spelling variants of words: an index of variable-length grams finds words one letter apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import texts, to_batch
from feedproj.session import checkpointed

# Fixed by the contract of op11.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10
SPOIL = 31
# End of fixed values.
#: Lengths of grams. Words must have at least twice the shortest.
SHORTEST, LONGEST = 3, 8
#: A gram that occurs more often in the words than this is no gram of its own: it goes on by a letter.
FREQUENT = 48
#: Slots of the gram dictionary, as bits: a fixed size, whatever the number of words.
SLOT_BITS = 21
#: Letters of the words a worker decomposes at once (at least one word), rows it hands on at once.
CELLS, ROWS = 200_000, 50_000
#: Distinct words a worker counts before it hands them on, and their letters.
WORDS, WORD_CHARS = 200_000, 16_000_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spoiled(doc: bytes, run: str, every: int) -> str:
    """The run without one letter, if the checksum of document and run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc + b":"))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, spoil: int | None = SPOIL,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``word`` and ``n`` (occurrences in all texts) of the words that are long and frequent enough.

    Words are whole runs of letters, A-Z lower-cased. One run in ``spoil`` loses a letter,
    chosen by document and run, so that the result can be told apart by known variants.
    """
    find = re.compile(f"[{LETTERS}]{{{least_chars},}}").findall
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        chars = 0

        def flush() -> pa.RecordBatch:
            out = to_batch(schema, [list(found), list(found.values())])
            found.clear()
            return out

        for batch in batches:
            for doc, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine: Counter[str] = Counter()
                for word, n in Counter(find(said)).items():
                    mine[word.lower() if word.isascii() else word.translate(LOWER)] += n
                name = b"" if doc is None else str(doc).encode()
                for word, n in mine.items():
                    if spoil:
                        word = spoiled(name, word, spoil)
                        if len(word) < least_chars:
                            continue
                    if word not in found:
                        chars += len(word)
                    found[word] += n
                if len(found) > WORDS or chars > WORD_CHARS:
                    yield flush()
                    chars = 0
        yield flush()

    return (
        texts(docs, key=key, text=text).mapInArrow(run, "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def tables(words: list[str]) -> Iterator[tuple[list[int], np.ndarray, dict[int, np.ndarray]]]:
    """The words in groups of like length: their numbers, lengths, and for each length of
    gram a hash of the gram that begins at each letter (beyond the word: no meaning)."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    while order:
        fit = 1
        while fit < len(order) and (fit + 1) * len(words[order[fit]]) <= CELLS:
            fit += 1
        part, order = order[:fit], order[fit:]
        size = np.array([len(words[i]) for i in part])
        wide = int(size.max()) + LONGEST
        said = b"".join(words[i].encode("latin-1").ljust(wide, b"\0") for i in part)
        letters = np.frombuffer(said, np.uint8).reshape(len(part), wide).astype(np.uint64)
        n = wide - LONGEST
        hashes, h = {}, np.zeros((len(part), n), np.uint64)
        with np.errstate(over="ignore"):
            for q in range(1, LONGEST + 1):
                h = h * np.uint64(0x100000001B3) + letters[:, q - 1 : q - 1 + n] + np.uint64(1)
                if q >= SHORTEST:
                    hashes[q] = _mixed(h + np.uint64(q))
        yield part, size, hashes


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def frequent_grams(words: DataFrame) -> np.ndarray:
    """The gram dictionary: for each slot, how often grams of it occur in all words, 0 up to ``FREQUENT``.

    Grams of ``SHORTEST`` to ``LONGEST`` letters of every word are counted, by a hash that
    gives the dictionary a fixed size; grams that share a slot only look more frequent than
    they are, in all words alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, size, hashes in tables(batch.column(0).to_pylist()):
                at = np.arange(next(iter(hashes.values())).shape[1])
                for q, h in hashes.items():
                    total += np.bincount(slots_of(h[at + q <= size[:, None]]), minlength=len(total))
        some = np.flatnonzero(total)
        for k in range(0, len(some), 500_000):
            part = some[k : k + 500_000]
            yield pa.RecordBatch.from_pydict({"slot": pa.array(part, pa.int32()), "n": pa.array(total[part], pa.int64())})

    often = words.select("word").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = often.where(F.col("n") > FREQUENT).select("slot", F.least("n", F.lit(65_535)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint16)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def decompose(size: np.ndarray, hashes: dict[int, np.ndarray], often: np.ndarray) -> dict[str, np.ndarray]:
    """The words' variable grams: from every letter on, to the right and to the left, the
    shortest gram that isn't frequent, or the longest there is.

    One row of arrays for each word and two columns for each letter, the gram to the right
    of it and the one to the left: ``there``, ``gram`` (hash), ``often``, and ``first`` and
    ``last``, the letters read to choose it. Which gram it is follows from these alone; the
    word's ends (places -1 and the length) are among them where an end stopped the gram.
    """
    w, n = next(iter(hashes.values())).shape
    at, end = np.arange(n), size[:, None]
    count = {q: np.where(at + q <= end, often[slots_of(h)].astype(np.int32), 0) for q, h in hashes.items()}
    right = np.full((w, n), SHORTEST)
    left = np.full((w, n), SHORTEST)

    def ending(x: np.ndarray, q: int) -> np.ndarray:
        """What belongs to the gram of ``q`` letters that ends at each letter."""
        out = np.zeros_like(x)
        out[:, q - 1 :] = x[:, : n - q + 1]
        return out

    for q in range(SHORTEST, LONGEST):
        right[(right == q) & (count[q] > 0) & (at + q < end)] = q + 1
        left[(left == q) & (ending(count[q], q) > 0) & (at >= q)] = q + 1
    out = {"there": np.zeros((w, 2 * n), bool)}
    for name, kind in (("gram", np.uint64), ("often", np.int32), ("first", np.int64), ("last", np.int64)):
        out[name] = np.zeros((w, 2 * n), kind)
    out["there"][:, 0::2] = at + SHORTEST <= end
    out["there"][:, 1::2] = (at >= SHORTEST - 1) & (at < end)
    for q, h in hashes.items():
        for side, mine, c, g in ((0, right == q, count[q], h), (1, left == q, ending(count[q], q), ending(h, q))):
            out["gram"][:, side::2][mine] = g[mine]
            out["often"][:, side::2][mine] = c[mine]
    stopped = out["often"] > 0
    out["first"][:, 0::2] = at
    out["last"][:, 0::2] = at + right - 1 + (stopped[:, 0::2] & (right < LONGEST))
    out["first"][:, 1::2] = at - left + 1 - (stopped[:, 1::2] & (left < LONGEST))
    out["last"][:, 1::2] = at
    return out


def two_grams(size: np.ndarray, grams: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the two rarest grams (columns) of which a letter can touch at most one.

    Any number of grams that no single place is read by holds two that share no place; so
    the bound on affected grams comes to two disjoint ones, the first left of the second.
    """
    w, m = grams["there"].shape
    n = m // 2
    # Cost above, column below, in one number.
    value = np.where(grams["there"], (grams["often"].astype(np.int64) + 1) * m + np.arange(m), np.iinfo(np.int64).max // 4)
    ends = np.full((w, n + 2), np.iinfo(np.int64).max // 4)
    starts = ends.copy()
    row = np.repeat(np.arange(w), m)
    np.minimum.at(ends, (row, np.clip(grams["last"], 0, n + 1).ravel()), value.ravel())
    np.minimum.at(starts, (row, np.clip(grams["first"], 0, n + 1).ravel()), value.ravel())
    before = np.minimum.accumulate(ends, axis=1)[:, :-1]
    after = np.minimum.accumulate(starts[:, ::-1], axis=1)[:, ::-1][:, 1:]
    cut = np.argmin(before // m + after // m, axis=1)
    rows = np.arange(w)
    return before[rows, cut] % m, after[rows, cut] % m


def list_names(gram: np.ndarray, side: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The list of words of a length that have a gram at a place."""
    with np.errstate(over="ignore"):
        where = (length.astype(np.uint64) << np.uint64(32)) + (place.astype(np.uint64) << np.uint64(1)) + side.astype(np.uint64)
        return _mixed(gram + _mixed(where)).view(np.int64)


def _listed(often: np.ndarray, looking: bool):
    """A task's words under the names of their lists, or of the lists they look into."""
    schema = pa.schema([("list", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, size, hashes in tables(batch.column(0).to_pylist()):
                grams = decompose(size, hashes, often)
                if looking:
                    rows = np.arange(len(part))
                    names, who = [], []
                    for column, shift in zip(two_grams(size, grams), (0, 1), strict=True):
                        for longer in (0, 1):
                            place = column // 2 + shift * longer
                            names.append(list_names(grams["gram"][rows, column], column % 2, place, size + longer))
                            who.append(rows)
                    names, who = np.concatenate(names), np.concatenate(who)
                else:
                    who, column = np.nonzero(grams["there"])
                    names = list_names(grams["gram"][who, column], column % 2, column // 2, size[who])
                index = np.array(part)[who]
                for k in range(0, len(index), ROWS):
                    some = pa.array(index[k : k + ROWS])
                    yield to_batch(schema, [names[k : k + ROWS], batch.column(0).take(some), batch.column(1).take(some)])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: each pair of the words (``word``, ``n``) one letter apart, once.

    A word is listed under all its variable grams, each with its place and the word's length.
    It looks into the lists of two disjoint grams: of words as long, at the same place, and of
    words one letter longer, where the second gram is one place on. A letter put in left of
    or inside the first gram leaves the second one as it is, any other leaves the first. What
    it meets is verified. Spark splits long lists.
    """
    often = words.sparkSession.sparkContext.broadcast(frequent_grams(words))

    def listed(looking: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _listed(often.value, looking)(batches)

        return words.select("word", "n").mapInArrow(run, "list bigint, word string, n bigint")

    looks = listed(True).select("list", F.col("word").alias("a"), F.col("n").alias("a_n"))
    lists = listed(False).select("list", F.col("word").alias("b"), F.col("n").alias("b_n"))
    once = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    return (
        looks.join(lists, "list").where(once & (F.levenshtein("a", "b", 1) == 1))
        .select("a", "a_n", "b", "b_n").distinct()
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the last form when each word's form (``word``, ``form``) is followed.

    A form occurs many times as often as its word, so chains are short and end. Each round
    doubles the steps taken; tables are written to the shared folder.
    """
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = checkpointed(
            now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved"))
        )
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def group_variants(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
    spoil: int | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every frequent word of whole texts.

    Two words are near if one inserted, deleted or replaced letter makes one of the other. A
    word's form is its most frequent near word (ties: the smallest), if that occurs at least
    ``ratio`` times as often; forms are followed to the root. A word without a form is its own root.

    Words are letter runs of at least ``least_chars`` letters, found ``least_count`` times or
    more. NULL and empty texts have none, a NULL id only changes which runs ``spoil`` picks,
    repeated rows count again, further columns are ignored, an empty table gives no rows. Of
    long texts and long words nothing is cut.
    """
    if least_chars < 2 * SHORTEST or ratio < 2:
        raise ValueError(f"words need at least {2 * SHORTEST} letters to share a gram with every near word, forms a ratio of 2")
    words = checkpointed(word_counts(docs, least_chars, least_count, spoil, key, text))
    pairs = checkpointed(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select("b", "b_n", "a", "a_n")
    )
    near = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    found = checkpointed(
        words.select("word", "n").join(near, "word", "left")
        .withColumn("has", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("has"), F.col("best.other")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n"),
        )
    )
    return (
        found.join(roots(found.where("form is not null")), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
