"""Substring dedup by hashed units: sentences and all stretches of 50 words, first occurrence kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import by_bytes, kept_in_worker, texts, to_batch, unpacked, whole_rows
from feedproj.llm.jaccard_join import _mixed
from feedproj.session import Staging

#: Words a run of repeated units has at least to be removed.
LEAST_WORDS = 25
#: Units with fewer words have no digest: they go with the run around them.
LEAST_UNIT_WORDS = 3
#: Words of a stretch: one that an earlier document holds goes, wherever it begins and ends.
STRETCH = 50
#: Words of the shingles by which stretches find each other. Every stretch holds its least shingle.
SHINGLE = 16
#: One in 2**CUT_BITS shingles begins a new chunk of stretches, which are compared as one.
CUT_BITS = 7
#: A word; in scripts written without spaces (Thai to Khmer, kana, Han) each character is one.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"
WORD = re.compile(f"[{ALONE}]|[^\\W_{ALONE}]+")
#: Fixed: a unit ends with its line or after marks that end a sentence.
MARKS = re.compile("[.!?]*").match
#: Kinds of characters: parts of words, words of their own (the second are no parts of a sentence's words), ends of units.
LETTER, LETTER_ALONE, MARK_ALONE, END = 1, 2, 3, 4
#: Odd factor of the rolling hash, and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Tells digests of sentences from those of stretches.
SENTENCE = np.uint64(0xD1B54A32D192ED03)
#: Characters of the texts read at once, or one longer text.
READ = 250_000


class Rolling:
    """Kinds and hashes of characters and powers of the rolling hash, as a worker keeps them."""

    def __init__(self):
        every = "".join(map(chr, range(0x110000)))
        self.kinds = np.zeros(len(every), np.uint8)
        for m in re.finditer(r"[^\W_]+", every):
            self.kinds[m.start() : m.end()] = LETTER
        for m in re.finditer(f"[{ALONE}]+", every):
            part = self.kinds[m.start() : m.end()]
            part[:] = np.where(part, LETTER_ALONE, MARK_ALONE)
        self.kinds[[ord(c) for c in "\n.!?"]] = END
        self.hashes = _mixed(np.arange(1, len(every) + 1, dtype=np.uint64) * np.uint64(FACTOR))
        self.steps = np.ones((2, 1), np.uint64)

    def powers(self, n: int) -> np.ndarray:
        """Of the factor and of its inverse, from 0 to ``n`` at least."""
        if self.steps.shape[1] <= n:
            steps = np.full((2, 2 * n + 1), [[FACTOR], [INVERSE]], np.uint64)
            steps[:, 0] = 1
            self.steps = np.multiply.accumulate(steps, 1)
        return self.steps


class Words:
    """Words from ``starts`` to ``ends``, two 64-bit hashes of each, and of any run of them."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, powers: np.ndarray):
        self.starts, self.ends, self.powers = starts, ends, powers
        one = _mixed((sums[ends] - sums[starts]) * powers[1, starts])
        n = len(starts)
        self.sums = np.zeros((2, n + 1), np.uint64)
        for k, hashes in enumerate((one, _mixed(one + np.uint64(FACTOR)))):
            np.cumsum(hashes * powers[0, :n], out=self.sums[k, 1:])

    def between(self, starts, ends, which: int) -> np.ndarray:
        """Hash of the words of each range: equal words, equal hash."""
        return (self.sums[which, ends] - self.sums[which, starts]) * self.powers[1, starts]

    def both(self, starts, ends) -> np.ndarray:
        return np.stack([self.between(starts, ends, k) for k in (0, 1)], 1).view(np.int64)


class Texts:
    """Words, sentences and stretches of several texts, as arrays over all of them.

    ``words`` are the stretches' words, ``bounds`` each text's first one. ``firsts`` and
    ``lasts`` are the ranges of ``plain`` words (runs of letters in all scripts) of the
    sentences that have any, ``sizes`` their lengths, ``digests`` their hashes, ``of`` their texts.
    """

    def __init__(self, said: list[str], rolling: Rolling | None = None):
        self.rolling = rolling = kept_in_worker("passages", Rolling) if rolling is None else rolling
        self.said = said
        joined = "\n".join(said)
        low = joined.lower()
        if len(low) != len(joined):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        self.begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in said], dtype=np.int64)])
        kinds, powers = rolling.kinds[codes], rolling.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(rolling.hashes[codes] * powers[0, :n], out=sums[1:])
        runs = lambda found: np.flatnonzero(np.diff(found, prepend=False, append=False)).reshape(-1, 2).T
        alone = (kinds == LETTER_ALONE) | (kinds == MARK_ALONE)
        self.plain = self.words = Words(*runs((kinds == LETTER) | (kinds == LETTER_ALONE)), sums, powers)
        if alone.any():
            (starts, ends), own = runs(kinds == LETTER), np.flatnonzero(alone)
            starts, ends = np.append(starts, own), np.append(ends, own + 1)
            order = np.argsort(starts)
            self.words = Words(starts[order], ends[order], sums, powers)
        self.bounds = np.searchsorted(self.words.starts, self.begins)
        self.breaks = np.flatnonzero(kinds == END)
        unit = np.searchsorted(self.breaks, self.plain.starts)
        self.firsts = np.flatnonzero(np.diff(unit, prepend=-1))
        self.lasts = np.append(self.firsts[1:], len(unit))[: len(self.firsts)]
        self.sizes = self.lasts - self.firsts
        self.digests = self.plain.both(self.firsts, self.lasts)
        self.digests[:, 0] ^= SENTENCE.astype(np.int64)
        self.of = np.searchsorted(self.begins, self.plain.starts[self.firsts], "right") - 1

    def sentence_span(self, unit: int) -> tuple[int, int]:
        """Where the sentence starts and ends in its text, white space around it left out."""
        begin, text = int(self.begins[self.of[unit]]), self.said[self.of[unit]]
        at = np.searchsorted(self.breaks, self.plain.starts[self.firsts[unit]])
        start = max(int(self.breaks[at - 1]) + 1 - begin, 0) if at else 0
        end = min(int(self.breaks[at]) - begin, len(text)) if at < len(self.breaks) else len(text)
        end = MARKS(text, end).end()
        bare = text[start:end]
        return start + len(bare) - len(bare.lstrip()), start + len(bare.rstrip())

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word of every stretch, and its text."""
        sizes = np.diff(self.bounds)
        firsts = np.arange(max(0, len(self.words.starts) - STRETCH + 1))
        of = np.repeat(np.arange(len(sizes)), sizes)[: len(firsts)]
        inside = firsts + STRETCH <= self.bounds[1:][of]
        return firsts[inside], of[inside]

    def shingles(self) -> np.ndarray:
        n = max(0, len(self.words.starts) - SHINGLE + 1)
        return self.words.between(slice(0, n), slice(SHINGLE, SHINGLE + n), 0)

    def anchors(self, shingles: np.ndarray) -> np.ndarray:
        """The least shingle of each stretch: equal stretches have equal ones."""
        least, have, size = shingles, 1, STRETCH - SHINGLE + 1
        while have < size:
            step = min(have, size - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return least.view(np.int64)

    def chunks(self, starts: np.ndarray, of: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chunks' first stretches in ``starts``, and both hashes of all words of each chunk's stretches."""
        cuts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (shingles[starts] >> np.uint64(64 - CUT_BITS) == 0))
        last = np.append(cuts[1:], len(starts))[: len(cuts)] - 1
        return cuts, self.words.both(starts[cuts], starts[last] + STRETCH)

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        """Both hashes of each stretch."""
        return self.words.both(starts, starts + STRETCH)


def sentences(text: str) -> list[tuple[int, int, int, bytes | None]]:
    """(start, end, words, digest) of each sentence of each line; white space around it is left out."""
    read = Texts([text])
    return [
        (*read.sentence_span(k), n, d.tobytes() if n >= LEAST_UNIT_WORDS else None)
        for k, (n, d) in enumerate(zip(read.sizes.tolist(), read.digests, strict=True))
    ]


def stretches(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each stretch: one begins at every word that has enough words after it."""
    read = Texts([text])
    starts, _ = read.starts()
    where = zip(read.words.starts[starts].tolist(), read.words.ends[starts + STRETCH - 1].tolist(), read.hashes(starts), strict=True)
    return [(a, b, STRETCH, d.tobytes()) for a, b, d in where]


def units(text: str) -> list[tuple[int, int, int, bytes | None]]:
    """(start, end, words, digest) of each sentence and of each stretch."""
    return sentences(text) + stretches(text)


def spans_to_remove(text: str, repeated: set[bytes], least_words: int = LEAST_WORDS, whole: bool = True) -> list[tuple[int, int]]:
    """Spans of what occurs in an earlier document or earlier in this one: runs of sentences and stretches.

    Spans with no word between them are one. A span that starts a line and ends one takes its
    line break with it. Without ``whole`` no stretch of the text is known to be repeated.
    """
    return next(spans_of_texts([text], [np.frombuffer(b"".join(repeated), np.int64).reshape(-1, 2)], [whole], least_words))


def spans_of_texts(said: list[str], repeated: list[np.ndarray], whole: list[bool], least_words: int) -> Iterator[list[tuple[int, int]]]:
    """:func:`spans_to_remove` of several texts, read at once."""
    read = Texts(said)
    long = read.sizes >= LEAST_UNIT_WORDS
    # Equal sentences of a text stand together here, in their order: all but the first are repeats.
    order = np.lexsort((read.digests[:, 1], read.digests[:, 0], read.of))
    same = (np.diff(read.digests[order], axis=0) == 0).all(1) & (np.diff(read.of[order]) == 0)
    again = np.zeros(len(order), bool)
    again[order[1:][same]] = True
    unit_bounds = np.searchsorted(read.of, np.arange(len(said) + 1))
    some = np.flatnonzero(np.asarray(whole, bool))
    if len(some):
        starts, of = read.starts()
        shingles = read.shingles()
        cuts, digests = read.chunks(starts, of, shingles)
        bounds = np.searchsorted(of, np.arange(len(said) + 1))
        cut_bounds = np.searchsorted(cuts, bounds)
    for k, text in enumerate(said):
        at = slice(unit_bounds[k], unit_bounds[k + 1])
        found = repeated_runs(read, at, long[at] & (again[at] | held(read.digests[at], repeated[k])), long[at], least_words)
        if whole[k]:
            own = slice(cut_bounds[k], cut_bounds[k + 1])
            covered = np.repeat(held(digests[own], repeated[k]), np.diff(np.append(cuts[own], bounds[k + 1])))
            found = sorted(found + repeated_stretches(read, k, starts[bounds[k] : bounds[k + 1]], covered, repeated[k]))
        yield joined_spans(text, found)


def joined_spans(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for start, end in found:
        if spans and not WORD.search(text, spans[-1][1], max(start, spans[-1][1])):
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    for span in spans:
        start, end = span
        while end < len(text) and text[end] in " \t":
            end += 1
        if (start == 0 or text[start - 1] == "\n") and end < len(text) and text[end] == "\n":
            end += 1
        span[1] = end
    return [(start, end) for start, end in spans]


def held(digests: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which rows of ``digests`` are rows of ``repeated``."""
    if not len(repeated):
        return np.zeros(len(digests), bool)
    known = repeated[np.argsort(repeated[:, 0])]
    at = np.minimum(np.searchsorted(known[:, 0], digests[:, 0]), len(known) - 1)
    half = known[at, 0] == digests[:, 0]
    found = half & (known[at, 1] == digests[:, 1])
    unsure = np.flatnonzero(half & ~found)
    if len(unsure):  # another row may have the same first half
        rows = set(map(tuple, repeated.tolist()))
        found[unsure] = [tuple(x) in rows for x in digests[unsure].tolist()]
    return found


def repeated_stretches(read: Texts, text: int, starts: np.ndarray, covered: np.ndarray, repeated: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the text's stretches that are ``covered`` by a chunk or in ``repeated``, or repeat one that ends before them."""
    if not len(starts):
        return []
    digests = read.hashes(starts)
    _, first, which = np.unique(digests[:, 0], return_index=True, return_inverse=True)
    gone = starts[held(digests, repeated) | covered | (first[which] <= np.arange(len(digests)) - STRETCH)]
    if not len(gone):
        return []
    cuts = np.flatnonzero(np.diff(gone) > STRETCH) + 1
    begin = int(read.begins[text])
    firsts, lasts = gone[np.append(0, cuts)], gone[np.append(cuts, len(gone)) - 1] + STRETCH - 1
    return list(zip((read.words.starts[firsts] - begin).tolist(), (read.words.ends[lasts] - begin).tolist(), strict=True))


def repeated_runs(read: Texts, at: slice, gone: np.ndarray, long: np.ndarray, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Spans of the runs of repeated sentences. Those without a digest belong to a run that goes on after them."""
    if not gone.any():
        return []
    sizes, stays, gone = read.sizes[at].tolist(), (long & ~gone).tolist(), gone.tolist()
    spans, k = [], 0
    while k < len(gone):
        if not gone[k]:
            k += 1
            continue
        last, j, words, tail = k, k, 0, 0
        while j < len(gone) and not stays[j]:
            tail += sizes[j]
            if gone[j]:
                last, words, tail = j, words + tail, 0
            j += 1
        if words >= least_words:
            spans.append((read.sentence_span(at.start + k)[0], read.sentence_span(at.start + last)[1]))
        k = last + 1
    return spans


def unit_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``h1``, ``h2``, ``doc_id``, ``whole``: a row for each distinct sentence, chunk and (without ``h2``) anchor of a document.

    ``whole`` are chunks, and anchors of stretches that do not overlap: where they are repeated, stretches are.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), 0
            for said in by_bytes(batch.column(1).to_pylist(), READ):
                own = ids[at : at + len(said)]
                at += len(said)
                read = Texts(said)
                long = read.sizes >= LEAST_UNIT_WORDS
                digests, of = read.digests[long], read.of[long]
                order = np.lexsort((digests[:, 1], digests[:, 0], of))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(digests[order], axis=0) != 0).any(1) | (np.diff(of[order]) != 0)
                order = order[new]
                starts, of_start = read.starts()
                shingles = read.shingles()
                cuts, chunks = read.chunks(starts, of_start, shingles)
                both = np.concatenate([digests[order], chunks])
                owners = np.concatenate([of[order], of_start[cuts]])
                yield to_batch(schema, [both[:, 0].copy(), both[:, 1].copy(), own[owners], np.arange(len(both)) >= len(order)])
                if not len(starts):
                    continue
                # Neighbours share their anchor mostly: only where it changes, its run's first and last stretch count.
                all_of = read.anchors(shingles)[starts]
                begins = np.flatnonzero((np.diff(of_start, prepend=-1) != 0) | np.append(True, np.diff(all_of) != 0))
                ends = np.append(begins[1:], len(starts)) - 1
                order = np.lexsort((all_of[begins], of_start[begins]))
                some, owners = all_of[begins][order], of_start[begins][order]
                first = np.flatnonzero(np.append(True, (np.diff(some) != 0) | (np.diff(owners) != 0)))
                again = np.maximum.reduceat(ends[order], first) - begins[order][first] >= STRETCH
                yield to_batch(schema, [some[first], pa.nulls(len(first), pa.int64()), own[owners[first]], again])

    return texts(docs.where(F.col(f"`{key}`").isNotNull()), key=key, text=text).mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, whole boolean")


def _shared(found: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``found`` whose keys more than one document has, with the ``first`` of them."""
    first = found.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return found.join(first.select(*keys, "first"), list(keys))


def stretch_rows(docs: DataFrame, near: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``h1``, ``h2``, ``doc_id``: the stretches of each document that have one of its ``anchors`` and are in none of the chunks ``h1``, ``h2``."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column(0).to_numpy(), 0
            for said in by_bytes(batch.column(1).to_pylist(), READ):
                read = Texts(said)
                starts, of = read.starts()
                shingles = read.shingles()
                anchors = read.anchors(shingles)[starts] if len(starts) else starts
                cuts, digests = read.chunks(starts, of, shingles)
                bounds = np.searchsorted(of, np.arange(len(said) + 1))
                cut_bounds = np.searchsorted(cuts, bounds)
                for k in range(len(said)):
                    mine = slice(bounds[k], bounds[k + 1])
                    kept = np.isin(anchors[mine], batch.column(2)[row].values.to_numpy())
                    if batch.column(3)[row].is_valid:
                        chunk = slice(cut_bounds[k], cut_bounds[k + 1])
                        known = np.stack([batch.column(c)[row].values.to_numpy() for c in (3, 4)], 1)
                        kept &= ~np.repeat(held(digests[chunk], known), np.diff(np.append(cuts[chunk], bounds[k + 1])))
                    own = read.hashes(starts[mine][kept])
                    own = own[np.unique(own[:, 0], return_index=True)[1]]
                    yield to_batch(schema, [own[:, 0].copy(), own[:, 1].copy(), np.full(len(own), ids[row])])
                    row += 1

    said = texts(docs.where(F.col(f"`{key}`").isNotNull()), key=key, text=text).where(F.octet_length("text") >= STRETCH)
    met = said.join(near, "doc_id").select("doc_id", "text", "anchors", "h.h1", "h.h2")
    return met.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint")


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns), ``removed`` (spans of original characters) and ``kept_text`` of each row.

    Units are normalised (lower case, words only) and hashed; a digest's first occurrence is
    that in the document with the smallest id, at its first place there. Of later occurrences,
    runs of sentences with ``least_words`` words or more are removed, and every stretch of
    ``STRETCH`` words, whatever its borders. Equal stretches have equal anchors, so stretches
    meet only where documents share an anchor; those in a chunk that a smaller document holds
    need not, as it holds them all, and the smallest holder of a stretch always sends it. Only
    digests and ids meet in the global grouping, counted before the shuffle; the join back to a
    frequent digest may be split by Spark. Rows with equal ids are one document. NULL and
    empty texts have no units. Rows without an id neither lend nor lose units to others.
    """
    # Tables no later step reads are dropped at once, so they don't lie beside the last join's texts.
    first, second, kept = (Staging(docs.sparkSession) for _ in range(3))
    found = first(unit_rows(docs, key, text))
    later = lambda rows, whole: _shared(rows, "h1", "h2").where("doc_id > first").select("doc_id", F.struct("h1", "h2").alias("h"), whole.alias("whole"))
    known = second(later(found.where("h2 is not null"), F.col("whole")))
    near = _shared(found.where("h2 is null").select("h1", "doc_id"), "h1").groupBy("doc_id").agg(F.collect_set("h1").alias("anchors"))
    near = near.join(known.where("whole").groupBy("doc_id").agg(F.collect_set("h").alias("h")), "doc_id", "left")
    alike = second(stretch_rows(docs, near, key, text))
    again = second(found.where("h2 is null and whole").select("doc_id", F.lit(None).cast("struct<h1:bigint,h2:bigint>").alias("h"), F.lit(True).alias("whole")).distinct())
    first.clear()
    lost = kept(known.union(later(alike, F.lit(True))).union(again).groupBy("doc_id").agg(F.collect_set("h").alias("repeated"), F.max("whole").alias("whole")))
    second.clear()
    packed = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("said"), whole_rows(docs))
    met = packed.join(lost, "doc_id", "left")
    removed = _removed(F.col("said"), F.col("repeated.h1"), F.col("repeated.h2"), F.col("doc_id").isNull() | F.coalesce("whole", F.lit(False)), least_words)
    marked = met.select("row", "said", removed.alias("removed"))
    end = lambda i: F.when(i > 0, F.get(F.col("removed"), i - 1)["end"]).otherwise(0)
    between = F.transform("removed", lambda s, i: F.substring(F.col("said"), end(i) + 1, s["start"] - end(i)))
    tail = F.expr("substring(said, element_at(removed, -1).end + 1)")
    return marked.select(
        "row", "removed",
        F.when(F.size("removed") == 0, F.col("said")).otherwise(F.concat(F.array_join(between, ""), tail)).alias("kept_text"),
    )


def _removed(said, h1, h2, whole, least_words: int):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(said: pd.Series, h1: pd.Series, h2: pd.Series, whole: pd.Series) -> pd.Series:
        out, none = [], np.zeros((0, 2), np.int64)
        repeated = [none if a is None else np.stack([np.asarray(a, np.int64), np.asarray(b, np.int64)], 1) for a, b in zip(h1, h2, strict=True)]
        some = whole.tolist()
        for part in by_bytes(said.tolist(), READ):
            at = slice(len(out), len(out) + len(part))
            out += [[{"start": x, "end": y} for x, y in found] for found in spans_of_texts(part, repeated[at], some[at], least_words)]
        return pd.Series(out)

    return spans(said, h1, h2, whole)


def filtered(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts (its length in ``n_chars``); other columns as they were."""
    gone = F.size("removed") > 0
    changed = {"text": F.when(gone, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(gone, F.char_length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpacked(remove_repeats(docs), docs.columns, **changed)
