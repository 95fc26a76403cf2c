"""Best-fit packing of tokenised documents into sequences, improved by local search."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import Aged, by_bytes, kept_in_worker, one_thread_each, texts, to_batch
from feedproj.session import checkpointed

SEQUENCE = 2048
#: Pieces packed together in one task. More waste less: a block leaves about one bin open.
BLOCK = 5_000
#: Bytes a worker's memory of encoded words takes, in each of its two halves.
REMEMBERED = 120_000_000
#: Characters of text a worker splits at once (at least one text).
CHARS = 4_000_000
#: For each bin above the least possible number, so many of the emptiest bins are worked on at first.
EMPTIED = 4
#: Unknown words encoded in one call.
JOINED = 256
#: Fixed: the mark at the end of a token that ends a piece, and words that the tokenizer never cuts
#: into pieces: letters of Latin-1, which no normal form changes.
END_OF_PIECE = "</w>"
ONE_PIECE = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+").fullmatch
#: Characters that Python's split() takes for white space and the tokenizer does not.
SPLIT_ONLY = re.compile("[\x1c-\x1f]").search


class WordTokens:
    """Ids of texts, as bytes. The tokenizer drops white space, so words encode independently."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        one_thread_each()
        tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.tokenize_many = tokenizer.encode, tokenizer.encode_batch_fast
        names = tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(END_OF_PIECE)]] = True
        self.known = Aged(REMEMBERED)

    def encode(self, words: list[str]) -> Iterator[bytes]:
        """The words' ids. Words of Latin letters alone are one piece each, whose last token says so."""
        plain = [w for w in words if ONE_PIECE(w)]
        found: dict[str, bytes] = {}
        for at in range(0, len(plain), 16 * JOINED):
            parts = [plain[k : k + JOINED] for k in range(at, min(len(plain), at + 16 * JOINED), JOINED)]
            for part, got in zip(parts, self.tokenize_many([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part):
                    ends = (4 * cuts).tolist()
                    said = ids.tobytes()
                    found.update((w, said[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self.encode_apart(rest), strict=True))
        return map(found.__getitem__, words)

    def encode_apart(self, words: list[str]) -> Iterator[bytes]:
        """The ids of any words, many in one text; offsets tell them apart."""
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            got = self.tokenize(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            ids, cuts = np.array(got.ids, "<u4"), np.searchsorted([a for a, _ in got.offsets], starts)
            yield from (ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def documents(self, texts: list[str]) -> Iterator[bytes]:
        for some in by_bytes(texts, CHARS):
            split = [re.split("[ \t\n]+", x) if SPLIT_ONLY(x) else x.split() for x in some]
            known = self.known.learn(set().union(*split), self.encode)
            yield from (b"".join(map(known.__getitem__, words)) for words in split)


def cut(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of each document's ids, ``end_id`` appended: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    Only documents longer than ``longest`` are cut. NULL and empty texts give one piece, the
    end id. Repeated rows give repeated pieces; NULL ids stay NULL.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end, step = np.array([end_id], "<u4").tobytes(), 4 * longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(f"words_{tokenizer}", lambda: WordTokens(tokenizer))
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.documents(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield to_batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * 5)

    return texts(docs, key=key, text=text).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item positions: each item, longest first, into the fullest bin it fits."""
    bins: list[list[int]] = []
    open_: list[tuple[int, int]] = []  # free room, bin
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(open_, (sizes[item], -1))
        if at == len(open_):
            bins.append([item])
            free, b = room, len(bins) - 1
        else:
            free, b = open_.pop(at)
            bins[b].append(item)
        if free > sizes[item]:
            insort(open_, (free - sizes[item], b))
    return bins


def improve(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Local search over the bins with room: moves and exchanges that raise the sum of squared fills.

    For every pair of a fuller and an emptier bin, the best of three steps is taken: move a
    document to the fuller bin, exchange one of its documents for a longer one, or for two
    that are longer together. Each raises the fuller fill and lowers the emptier one, so the
    sum of squares rises and the search ends; a bin that empties is gone. The emptiest bins
    are worked on first, then twice as many, until there are as few bins as the tokens need
    or a sweep over all of them changes nothing. A pair is looked at again only if one of
    the two has changed.
    """
    load = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(load) // room)
    changed_at, tried_at, now = [0] * len(bins), [-1] * len(bins), 0
    wide = EMPTIED
    while True:
        order = sorted((b for b in range(len(bins)) if bins[b] and load[b] < room), key=lambda b: (-load[b], b))
        over = sum(map(bool, bins)) - least
        if over <= 0:  # as few as the tokens allow
            break
        before = now
        for low in order[: -wide * over - 1 : -1]:
            fresh, started = changed_at[low] > tried_at[low], now
            into = sorted((sizes[i], i) for i in bins[low])
            for high in order:
                if not into:
                    break
                if high == low or load[high] < load[low] or load[high] == room:
                    continue
                if not (fresh or changed_at[high] > tried_at[low] or changed_at[low] > started):
                    continue
                while into and (step := _step(bins[high], into, sizes, room - load[high])):
                    gain, out, taken = step
                    for i in out:
                        bins[high].remove(i)
                        bins[low].append(i)
                    for i in taken:
                        bins[low].remove(i)
                        bins[high].append(i)
                    load[high] += gain
                    load[low] -= gain
                    now += 1
                    changed_at[high] = changed_at[low] = now
                    into = sorted((sizes[i], i) for i in bins[low])
            # Bins it met before it changed itself are met again in the next sweep.
            tried_at[low] = started
        if now == before:
            if wide * over >= len(order):
                break
            wide *= 2
    return [b for b in bins if b]


def _step(high: list[int], into: list[tuple[int, int]], sizes: list[int], free: int):
    """The largest gain in ``1..free`` for the fuller bin: (gain, items out of it, items into it).

    ``into``: sizes and items of the emptier bin, in order.
    """
    best = None
    plain = [s for s, _ in into]
    at = bisect_left(plain, free + 1) - 1
    if at >= 0:
        best = (plain[at], (), (into[at][1],))
    if best and best[0] == free:
        return best
    for x in high:
        most = sizes[x] + free
        at = bisect_left(plain, most + 1) - 1
        if at >= 0 and plain[at] > sizes[x] and (best is None or plain[at] - sizes[x] > best[0]):
            best = (plain[at] - sizes[x], (x,), (into[at][1],))
        left, right = 0, len(plain) - 1
        while left < right:
            both = plain[left] + plain[right]
            if both > most:
                right -= 1
                continue
            if both > sizes[x] and (best is None or both - sizes[x] > best[0]):
                best = (both - sizes[x], (x,), (into[left][1], into[right][1]))
            left += 1
        if best and best[0] == free:
            break
    return best


def pack(pieces: DataFrame, room: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (place in the sequence, gapless from 0).

    Full pieces are sequences by themselves. The rest is written and dealt by place into blocks
    of about ``block`` pieces, packed best-fit and improved by exchanges; only ids and lengths
    move. A block's packing depends on its rows alone, so a retried task gives the same answer.
    Sequence numbers: the block's number and the bin's. Repeated rows are packed as often as
    they occur. An empty input gives no rows.
    """
    pieces = checkpointed(pieces)
    blocks = max(1, round(pieces.where(F.col("length") < room).count() / block))
    # By the written row's place, so that exact repeats lie in as many blocks as any other rows.
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(names).sort_by([(n, "ascending") for n in names])
        sizes = rows.column("length").to_pylist()
        number = table.column("block")[0].as_py() << 32
        seq, at = [0] * len(sizes), [0] * len(sizes)
        for n, items in enumerate(improve(best_fit(sizes, room), sizes, room)):
            place = 0
            for i in sorted(items):
                seq[i], at[i] = number + n, place
                place += sizes[i]
        return rows.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(at, pa.int64()))

    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    open_ = dealt.where(F.col("length") < room).groupBy("block").applyInArrow(run, ddl)
    # Negative numbers: no block has them. The id is unique for each row of the written table.
    full = pieces.where(F.col("length") >= room).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return open_.union(full)
