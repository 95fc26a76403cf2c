"""Toxicity: averaged subword-bag embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import texts, to_batch

#: Labelled documents of each class the classifier is fitted to at most, by the order of a hash.
SAMPLE_PER_CLASS = 1500
BUCKETS = 1 << 17
DIMENSIONS = 8
SMALLEST, LARGEST = 3, 6
#: Words averaged at a time. A document scores as its worst window.
WINDOW = 24
#: A window's distinct words are averaged over so many places at least, so few words cannot decide alone.
LEAST_PLACES = 16
#: Subwords in fewer documents of the sample stay zero: they would only memorise those documents.
LEAST_DOCUMENTS = 8
THRESHOLD = 0.7
#: Distinct words a worker remembers before it starts anew.
WORDS = 500_000
#: A word of more than twice so many characters is cut into pieces of so many, which count as words of the text.
WORD_CHARS = 40
EDGES = re.compile(r"^[\W_]+|[\W_]+$").sub


def words_of(text: str) -> list[str]:
    """Words of a text. Long ones come in pieces, each after a space, that together hold all n-grams of the marked word."""
    found = []
    for word in text.lower().split():
        if len(word) > 2 * WORD_CHARS:
            word = EDGES("", word) or word
            if len(word) > 2 * WORD_CHARS:
                marked = f"<{word}>"
                found += [" " + marked[i : i + WORD_CHARS] for i in range(0, len(marked) - LARGEST + 1, WORD_CHARS - LARGEST + 1)]
                continue
        found.append(word)
    return found


def subwords(word: str) -> list[int]:
    """Buckets of the word and its character n-grams, with ``<`` and ``>`` at its ends. A piece has its own marks."""
    if word[0] == " ":
        bare = marked = word[1:]
    else:
        bare = EDGES("", word) or word
        marked = f"<{bare}>"
    if marked.isascii():
        marked = marked.encode()
        grams = [marked[i : i + n] for n in range(SMALLEST, LARGEST + 1) for i in range(len(marked) - n + 1)]
    else:
        grams = [marked[i : i + n].encode() for n in range(SMALLEST, LARGEST + 1) for i in range(len(marked) - n + 1)]
    grams.append(f"={bare}".encode())
    return [crc % BUCKETS for crc in map(zlib.crc32, grams)]


def windows(n: int, size: int = WINDOW) -> list[tuple[int, int]]:
    """Cuts of n words into windows of ``size``; a short rest joins the window before it."""
    count = max(1, round(n / size))
    return [(k * size, n if k == count - 1 else (k + 1) * size) for k in range(count)]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIMENSIONS
    out: np.ndarray  # DIMENSIONS x 2
    bias: np.ndarray  # 2

    def margins(self) -> np.ndarray:
        """What one subword adds to the margin of class 1 over class 0."""
        return (self.table @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


class Bags:
    """Distinct words as lists of buckets, documents as arrays of word numbers."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.buckets: list[np.ndarray] = []

    def words(self, text: str) -> np.ndarray:
        found = []
        for w in words_of(text):
            if (n := self.number.get(w)) is None:
                n = self.number[w] = len(self.buckets)
                self.buckets.append(np.array(subwords(w), np.int32))
            found.append(n)
        return np.array(found, np.int32)


def train(labelled: list[tuple[str, int]], seed: int = 7, rounds: int = 6, rate: float = 0.3) -> Model:
    """Fit to (text, label) pairs by Adagrad on windows.

    First every window carries its document's label; then, in each later round, a document
    is represented by the window that now scores highest, as in scoring, and by one window
    in turn if its label is 0. Without both labels the model gives every text the base rate.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 2)), np.zeros(2))
    model.out[:, 1] = rng.normal(0, 0.1, DIMENSIONS)
    model.out[:, 0] = -model.out[:, 1]
    labels = np.array([y for _, y in labelled])
    if not len(labels) or labels.min() == labels.max():
        rate_1 = (labels.sum() + 0.5) / (len(labels) + 1)
        model.table[:] = 0
        model.bias[:] = np.log([1 - rate_1, rate_1])
        return model
    bags = Bags()
    docs = [[np.unique(d[a:b]) for a, b in windows(len(d))] if len(d) else [] for d in (bags.words(text) for text, _ in labelled)]
    sums = [np.full_like(model.table, 1e-8), np.full_like(model.out, 1e-8), np.full_like(model.bias, 1e-8)]
    sizes = np.array([len(b) for b in bags.buckets] or [0])
    flat = np.concatenate(bags.buckets) if bags.buckets else np.zeros(0, np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seen_in = np.zeros(BUCKETS, np.int32)
    for d in docs:
        if d:
            seen_in[np.unique(np.concatenate([bags.buckets[w] for w in np.unique(np.concatenate(d))]))] += 1
    used = seen_in >= LEAST_DOCUMENTS
    model.table[~used] = 0
    weight = {0: 0.5 / (labels == 0).sum(), 1: 0.5 / (labels == 1).sum()}

    def step(batch: list[tuple[int, int, float]]) -> None:
        parts = [docs[d][k] for d, k, _ in batch]
        words = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        n = sizes[words]
        at = np.repeat(starts[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        buckets, who = flat[at], np.repeat(owner, n)
        share = np.repeat(1.0 / (n * np.maximum(LEAST_PLACES, np.bincount(owner))[owner]), n)
        buckets, who, share = (x[used[flat[at]]] for x in (buckets, who, share))
        hidden = np.stack([np.bincount(who, share * model.table[buckets, k], len(parts)) for k in range(DIMENSIONS)], 1)
        logits = hidden @ model.out + model.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(parts)), [labels[d] for d, _, _ in batch]] -= 1
        p *= np.array([w for _, _, w in batch])[:, None]
        back = p @ model.out.T
        seen, local = np.unique(buckets, return_inverse=True)
        grad = np.stack([np.bincount(local, share * back[who, k], len(seen)) for k in range(DIMENSIONS)], 1)
        sums[0][seen] += grad * grad
        model.table[seen] -= rate * grad / np.sqrt(sums[0][seen])
        for value, total, g in ((model.out, sums[1], hidden.T @ p), (model.bias, sums[2], p.sum(0))):
            total += g * g
            value -= 0.3 * rate * g / np.sqrt(total)

    for turn in range(rounds):
        if turn < 2:
            chosen = [(d, k, weight[labels[d]] / len(c)) for d, c in enumerate(docs) for k in range(len(c))]
        else:
            margin = model.margins()
            of_word = np.add.reduceat(margin[flat], starts[:-1]) / sizes
            chosen = []
            for d, c in enumerate(docs):
                if c:
                    mean = [of_word[words].sum() / max(LEAST_PLACES, len(words)) for words in c]
                    chosen.append((d, int(np.argmax(mean)), weight[labels[d]]))
                    if not labels[d] and len(c) > 1:
                        chosen.append((d, (turn + d) % len(c), weight[0] * 0.5))
        scale = len(chosen) / sum(w for *_, w in chosen)
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), 64):
            step([(d, k, w * scale) for d, k, w in (chosen[i] for i in order[at : at + 64])])
    return model


class Scorer(dict):
    """Each word's share of the margin, remembered; a text's score is that of its worst window."""

    def __init__(self, margins: np.ndarray, bias: float):
        super().__init__()
        self.margins, self.bias = margins.tolist(), bias

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS:
            self.clear()
        grams = subwords(word)
        self[word] = out = sum(map(self.margins.__getitem__, grams)) / len(grams)
        return out

    def score(self, text: str) -> float:
        words = words_of(text)
        if not words:
            return 0.0
        worst = -np.inf
        for a, b in windows(len(words)):
            own = dict.fromkeys(words[a:b])
            worst = max(worst, sum(map(self.__getitem__, own)) / max(LEAST_PLACES, len(own)))
        return float(1 / (1 + np.exp(-np.clip(worst + self.bias, -60, 60))))


def sample(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = SAMPLE_PER_CLASS) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` documents of each class, by the order of a hash of the id.

    Rows without an id or a label of 0 or 1 are left out; a label given twice counts once.
    The ids are chosen from the labels alone, so only the chosen texts reach the driver.
    """
    given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)"
    ).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for label in (0, 1):
        part = given.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    found = texts(docs).where("doc_id is not null").join(F.broadcast(picked), "doc_id").collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row; NULL, empty and blank texts score 0."""
    margins = docs.sparkSession.sparkContext.broadcast(model.margins())
    bias = float(model.bias[1] - model.bias[0])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(margins.value, bias)
        for batch in batches:
            yield to_batch(schema, [batch.column(0), [scorer.score(x) for x in batch.column(1).to_pylist()]])

    return texts(docs, key=key, text=text).mapInArrow(run, "doc_id bigint, score double")
