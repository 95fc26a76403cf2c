"""N-gram Jaccard join with set-relation skipping: exact links between documents' shingle sets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import Groups, components, texts, to_batch, unpacked, whole_rows
from feedproj.llm.lattice_dedup import runs_of
from feedproj.session import Staging, checkpointed

#: Counters of the shingle frequency sketch, in blocks. Its size is fixed; it only orders shingles.
COUNTERS, COUNTER_BLOCK = 1 << 22, 1 << 14
#: Bits of a set's parity bitmap at least and at most; between them as many as tell its size of set apart.
LEAST_BITMAP, BITMAP = 128, 2048
#: Sets of an index list compared in one piece; longer lists are cut into pieces that meet in pairs.
PIECE = 1024
#: Index lists up to this long are thinned out while they are built; longer ones stay whole.
THINNED = 64
#: Rows a worker holds while it thins lists out.
HELD = 50_000
#: Index lists a set is in at most when the first, partial, round looks for similar sets.
FIRST_LISTS = 4
#: Distinct words a worker remembers before it starts anew.
WORDS = 500_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``size`` are one shingle."""
    words = text.encode().lower().split()  # on bytes: A-Z alone, and the white space of the word rule
    if not words:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    return np.unique(out)


def places(n: int, percent: int) -> int:
    """Places of the bitmap of a set of ``n`` shingles: so many that unrelated sets differ in more than a link allows."""
    most, size = 2 * n * (100 - percent) / (100 + percent), LEAST_BITMAP
    while size < BITMAP and size / 2 - 2.5 * size**0.5 < most:
        size *= 2
    return size


def bitmap(found: np.ndarray, size: int) -> np.ndarray:
    """Parity of the shingles in each place. Two bitmaps differ in no more places than their sets in shingles."""
    odd = np.bincount((found % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Bitmaps:
    """A column of bitmaps. A longer one is folded to the places of the shorter when they are compared."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks()
        self.words = pc.list_value_length(column).to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.words)
        self.flat = column.flatten().to_numpy().view(np.uint64)
        self.folded: dict[int, np.ndarray] = {}

    def of(self, words: int) -> np.ndarray:
        """All bitmaps of ``words`` words or more, folded; rows of shorter ones are 0."""
        if words not in self.folded:
            self.folded[words] = out = np.zeros((len(self.words), words), np.uint64)
            for own in np.unique(self.words[self.words >= words]).tolist():
                rows = np.flatnonzero(self.words == own)
                block = self.flat[(self.ends[rows] - own)[:, None] + np.arange(own)]
                out[rows] = np.bitwise_xor.reduce(block.reshape(len(rows), -1, words), axis=1)
        return self.folded[words]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many places the bitmaps of rows ``a`` and ``b`` differ."""
        least = np.minimum(self.words[a], self.words[b])
        out = np.empty(len(a), np.int64)
        for words in np.unique(least).tolist():
            here, bits = np.flatnonzero(least == words), self.of(words)
            out[here] = np.bitwise_count(bits[a[here]] ^ bits[b[here]]).sum(1, dtype=np.int64)
        return out


def common_counts(docs: DataFrame, size: int) -> Broadcast:
    """A log-scaled count for each counter of the sketch, over all documents' shingles."""
    kind = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for said in batch.column(1).to_pylist():
                np.add.at(counts, (shingles(said, size, hashes) % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
        for block, part in enumerate(counts.reshape(-1, COUNTER_BLOCK)):
            if part.any():
                yield to_batch(kind, [[block], [zlib.compress(part.tobytes(), 1)]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(part), np.uint32).astype(np.uint64)
                total[block] = total[block] + counts if block in total else counts
        for block, counts in total.items():
            ranks = np.minimum(255, 4 * np.log2(1.0 + counts)).astype(np.uint8)
            yield to_batch(kind, [[block], [ranks.tobytes()]])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "block int, counts binary"
    ranks = np.zeros(COUNTERS, np.uint8)
    for row in docs.mapInArrow(count, ddl).repartition(parts, "block").mapInArrow(add, ddl).collect():
        at = row["block"] * COUNTER_BLOCK
        ranks[at : at + COUNTER_BLOCK] = np.frombuffer(row["counts"], np.uint8)
    return docs.sparkSession.sparkContext.broadcast(ranks)


def signatures(docs: DataFrame, ranks: Broadcast, size: int, percent: int) -> DataFrame:
    """``doc_id``, ``n``, class (128 bits of the set), ``prefix`` (rarest shingles, as many as a link needs) and ``bits``."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("class_1", pa.int64()), ("class_2", pa.int64()),
        ("prefix", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rank = WordHashes(), ranks.value
        for batch in batches:
            rows = []
            for said in batch.column(1).to_pylist():
                found = shingles(said, size, hashes)
                n = len(found)
                if not n:
                    rows.append((0, None, None, [], []))
                    continue
                most = n - -(-percent * n // 100) + 1
                order = np.lexsort((found, rank[(found % np.uint64(COUNTERS)).astype(np.int64)]))[:most]
                name = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist()
                rows.append((n, *name, found[order].view(np.int64), bitmap(found, places(n, percent))))
            yield to_batch(schema, [batch.column(0), *zip(*rows, strict=True)] if rows else [[]] * 6)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, class_1 bigint, class_2 bigint, prefix array<bigint>, bits array<bigint>")


def similar_in_list(run: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of an index list, the earlier sets that it may link to, nearest first.

    The list is sorted by set size and cut where sizes are too far apart, then where prefix
    positions are: where a list's shingle is the rarest that two sets share, they share nothing
    before their positions in it. Sets that share a rarer one too are left to that one's list.
    The first set of the list answers for the rest: bitmaps are a metric, so two sets whose
    distances to it differ by more than a link allows need not be compared at all.
    """
    n, pos = run.column("n").to_numpy(), run.column("pos").to_numpy()
    piece = run.column("piece").to_numpy()
    cross = run.column("low")[0].as_py() != run.column("high")[0].as_py()
    bits = Bitmaps(run.column("bits"))
    shortest = bits.of(int(bits.words[0]))
    to_first = np.bitwise_count(shortest ^ shortest[0]).sum(1, dtype=np.int64)
    lowest = np.searchsorted(n, -(-percent * n // 100))
    for k in range(1, len(n)):
        at = np.arange(lowest[k], k)
        if cross:
            at = at[piece[at] != piece[k]]
        # A link's overlap is percent / (100 + percent) of both sizes at least; the rest may differ.
        most = ((100 - percent) * (n[at] + n[k])) // (100 + percent)
        shared = np.minimum(n[at] - pos[at], n[k] - pos[k])
        fit = (np.abs(to_first[at] - to_first[k]) <= most) & ((100 + percent) * shared >= percent * (n[at] + n[k]))
        at, most = at[fit], most[fit]
        if len(at):
            apart = bits.apart(at, np.full(len(at), k))
            near = apart <= most
            if near.any():
                yield k, at[near][np.argsort(apart[near], kind="stable")]


def with_partner(token: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: Bitmaps, percent: int) -> np.ndarray:
    """Which rows, sorted by token and size, may link to another row of their list.

    By size, by position and by the distance of the bitmaps, as in the comparison
    itself. All rows of a list longer than ``THINNED`` count as such.
    """
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(starts, len(token)))
    long_ = np.repeat(sizes > THINNED, sizes)
    keep = long_.copy()
    place = np.arange(len(token)) - np.repeat(starts, sizes)
    at = np.flatnonzero(~long_)
    for back in range(1, THINNED):
        at = at[place[at] >= back]
        # Sizes rise within a list: where this one is too far apart, those before are as well.
        at = at[100 * n[at - back] >= percent * n[at]]
        if not len(at):
            break
        j = at - back
        shared = np.minimum(n[at] - pos[at], n[j] - pos[j])
        both = n[at] + n[j]
        near = (100 + percent) * shared >= percent * both
        pair, j, both = at[near], j[near], both[near]
        fit = (100 + percent) * bits.apart(pair, j) <= (100 - percent) * both
        keep[pair[fit]] = keep[j[fit]] = True
    return keep


def index_lists(reps: DataFrame, percent: int) -> DataFrame:
    """``token``, ``rep``: the index lists, without sets that can link to no other set of the list.

    Rows are range-partitioned by shingle, size and set, so a long list lies over as many
    partitions as it fills. Sorted partitions stream through workers that hold a bounded
    number of rows. Lists that may go on in another partition, the first and the last, stay
    whole; so do long ones.
    """
    index = reps.select("rep", F.col("n").cast("int").alias("n"), "bits", F.posexplode("prefix").alias("pos", "token"))
    index = index.select("token", "n", "rep", "pos", "bits")
    schema = pa.schema([("token", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        whole = None  # the list that stays whole: the partition's first, then one cut by a full buffer

        def thinned(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, whole
            table = pa.Table.from_batches(held).combine_chunks()
            token, n, rep, pos = (c.to_numpy() for c in table.columns[:4])
            if whole is None:
                whole = token[0]
            end = len(token)
            if not last:  # the last list may go on: hold it back, unless it is long already
                begin = end - int((token[::-1] != token[-1]).argmax()) if token[0] != token[-1] else 0
                if end - begin > THINNED:
                    keep_from = token[-1]
                else:
                    keep_from, end = None, begin
            else:
                keep_from = token[-1]
            part = token[:end]
            keep = with_partner(part, n[:end].astype(np.int64), pos[:end].astype(np.int64), Bitmaps(table.column("bits").slice(0, end)), percent)
            keep |= part == whole
            if keep_from is not None:
                keep |= part == keep_from
                whole = keep_from
            held = table.slice(end).to_batches()
            yield to_batch(schema, [part[keep], rep[:end][keep]])

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= HELD:
                yield from thinned(last=False)
                rows = sum(b.num_rows for b in held)
        if held:
            yield from thinned(last=True)

    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["token", "n", "rep"]
    return index.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "token bigint, rep bigint")


PAIR = ["a_1", "a_2", "a", "b_1", "b_2", "b"]


def _pairs(lists: DataFrame, reps: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Candidate pairs from the index lists (``token``, ``rep``, ``lead``).

    ``whole``: every pair whose sets are not known to be in one component. Otherwise a pair
    for each set and list at most, enough to join similar sets, and each set paired with itself
    where it has any candidate.
    """
    counted = lists.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("lead").alias("one"), F.max("lead").alias("other"))
    open_ = counted.where("members > 1" + " and one < other" * whole).select("token", F.ceil(F.col("members") / PIECE).cast("int").alias("pieces"))
    met = lists.join(open_, "token").withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    met = met.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.withColumns({"low": F.least("piece", "meets"), "high": F.greatest("piece", "meets")})
    full = met.join(reps, "rep").withColumn("pos", F.array_position("prefix", F.col("token")) - 1).where("pos >= 0").select(
        F.xxhash64("token", "low", "high").alias("list"), "low", "high", "piece", "n", "pos", "rep", "class_1", "class_2", "lead", "bits"
    )
    schema = pa.schema([(c, pa.int64()) for c in PAIR])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, alone = Groups(), set()
        rows: list[tuple] = []
        for table in runs_of(batches):
            if len(table) < 2:
                continue
            rep, one, two, lead = (table.column(c).to_pylist() for c in ("rep", "class_1", "class_2", "lead"))
            for k, before in similar_in_list(table, percent):
                for j in before.tolist():
                    if whole:
                        if lead[j] != lead[k]:
                            rows.append((one[j], two[j], rep[j], one[k], two[k], rep[k]))
                        continue
                    for m in (j, k):
                        if (one[m], two[m]) not in alone:
                            alone.add((one[m], two[m]))
                            rows.append((one[m], two[m], rep[m]) * 2)
                    if groups.join(one[j], one[k]):
                        rows.append((one[j], two[j], rep[j], one[k], two[k], rep[k]))
                        break
            if len(rows) > 20_000:
                yield to_batch(schema, list(zip(*rows, strict=True)))
                rows = []
        if rows:
            yield to_batch(schema, list(zip(*rows, strict=True)))

    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(parts, "list").sortWithinPartitions("list", "n", "pos", "rep").mapInArrow(
        run, ", ".join(f"{c} bigint" for c in PAIR)
    ).distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link, by exact overlap."""
    side = lambda x: sets.select(F.col("class_1").alias(f"{x}_1"), F.col("class_2").alias(f"{x}_2"), F.col("shingles").alias(f"in_{x}"))
    met = pairs.join(side("a"), ["a_1", "a_2"]).join(side("b"), ["b_1", "b_2"])
    both = F.size(F.array_intersect("in_a", "in_b"))
    return met.where(100 * both >= percent * (F.size("in_a") + F.size("in_b") - both)).select("a", "b")


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", steps: Staging | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row: its set's size and the smallest id reachable by links.

    Words are runs of anything but space, tab and line ends, A-Z lower-cased. A set has the
    distinct ``size``-word shingles; fewer words are one shingle. Two documents link when
    their sets' Jaccard similarity is ``percent`` / 100 or more. Equal sets are one class,
    which is joined once. Index lists hold each class under its rarest shingles, as many as
    any link must share; rare by a sketch of fixed size, which orders but never drops.

    A first, partial round pairs each class with its nearest in a few lists. What it links
    answers for its whole component: the second round skips every pair inside a component
    and compares all others. So a large group of near copies is linked by about as many pairs
    as it has members, and no link between different components is lost.

    NULL, empty and blank texts have no set and link with nothing. Repeated rows and rows with
    equal ids are one document; rows with a NULL id take no part (``component_id`` NULL).
    ``steps`` holds the tables that the result is read from; it may be cleared once that is written.
    """
    steps = Staging(docs.sparkSession) if steps is None else steps
    said = texts(docs, key=key, text=text)
    ranks = common_counts(said, size)
    # Prefixes and bitmaps are kept once, with the classes: the table of all documents that has them goes.
    wide = Staging(docs.sparkSession)
    every = wide(signatures(said, ranks, size, percent))
    signed = steps(every.drop("prefix", "bits"))
    reps = steps(every.where("n > 0 and doc_id is not null").groupBy("class_1", "class_2").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits")]
    ))
    wide.clear()
    lists = steps(index_lists(reps, percent))
    # A set's shared shingles, rarest first: its prefix has them in that order.
    start = lists.groupBy("rep").agg(F.collect_list("token").alias("tokens")).join(reps.select("rep", "prefix"), "rep").select(
        "rep", F.explode(F.slice(F.array_intersect("prefix", "tokens"), 1, FIRST_LISTS)).alias("token"), F.col("rep").alias("lead")
    )
    first = steps(_pairs(start, reps, percent, whole=False))

    hashed = pa.schema([("class_1", pa.int64()), ("class_2", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(x, size, hashes) for x in batch.column(1).to_pylist()]
            names = [np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in found]
            both = np.concatenate([np.zeros(0, np.int64), *names]).reshape(-1, 2)
            yield to_batch(hashed, [both[:, 0].copy(), both[:, 1].copy(), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))])

    def sets_of(ids: DataFrame) -> DataFrame:
        """The sets of the classes named by a document, from its text."""
        # The hint gives small inputs the plan that large ones have.
        return said.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(whole_sets, "class_1 bigint, class_2 bigint, shingles array<bigint>").dropDuplicates(["class_1", "class_2"])

    ids = lambda pairs: pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = steps(sets_of(ids(first)))
    links = steps(_links(first.where("a <> b"), sets, percent))
    lead = steps(components(links))
    known = lists.join(lead.withColumnRenamed("id", "rep"), "rep", "left").select("token", "rep", F.coalesce("component_id", "rep").alias("lead"))
    second = steps(_pairs(known, reps, percent, whole=True))
    new = ids(second).join(ids(first), "doc_id", "left_anti")
    more = sets.union(sets_of(new)).dropDuplicates(["class_1", "class_2"])
    links = links.union(_links(second, more, percent))
    # Equal ids with different sets are one document, so classes are joined by the smallest ids.
    lead = components(links).withColumnRenamed("id", "rep")
    of_class = reps.select("class_1", "class_2", "rep").join(lead, "rep", "left").select(
        "class_1", "class_2", F.coalesce("component_id", "rep").alias("lead")
    )
    return signed.select("doc_id", "n", "class_1", "class_2").join(of_class, ["class_1", "class_2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("lead", "doc_id")).alias("component_id")
    )


def filtered(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id; rows without an id stay."""
    steps = Staging(docs.sparkSession)
    keep = checkpointed(link_documents(docs, steps=steps).where("doc_id = component_id").select("doc_id").distinct())
    steps.clear()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("other"), whole_rows(docs))
    # Repeated rows of the document that stays go as well. Of unlike texts with one id that with
    # the least hash stays, and of its rows the one with the least hash of all columns: no order decides.
    kept = rows.where("id is not null").join(keep.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    hashed = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = kept.groupBy("id").agg(F.min_by("row", F.struct("other", F.xxhash64(*hashed))).alias("row"))
    return unpacked(one.select("row").union(rows.where("id is null").select("row")), docs.columns)
