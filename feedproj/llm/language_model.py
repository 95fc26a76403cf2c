"""LM scoring: a gated recurrent model in numpy with a class-factored output, trained over the whole corpus."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import row_key, small_batches, texts, to_batch
from feedproj.session import checkpointed

#: Words with an output of their own, in classes of CLASS_WORDS by falling count; END is the first.
CLASSES, CLASS_WORDS = 32, 32
#: Classes of all other words, by their last letters. Inside them a word has its smoothed corpus share.
RARE_CLASSES = 32
HIDDEN = 16
#: Words whose counts every worker gets, at most, and how long such a word is at most in bytes.
TOP_WORDS, TOP_BYTES = 120_000, 64
#: Training: streams side by side, steps of truncated backpropagation, and Adam's rate.
STREAMS, STEPS, RATE = 256, 32, 6e-3
#: Bounds of output weights and of biases above the largest first bias: no logit overflows exp().
MOST_WEIGHT, MOST_BIAS = 3.0, 8.0
#: Rounds of training. Each takes its share of the documents (by a hash, of 32 parts) in every partition;
#: then the partitions' weights are averaged. Together the rounds take every training document once.
ROUNDS = ((0, 2), (2, 8), (8, 32))
#: Tokens laid side by side at a time, and streams in scoring.
CHUNK_TOKENS, SCORE_STREAMS, SCORE_STEPS = 600_000, 256, 32
#: Words counted in a worker before the counts are passed on, and bytes of texts that are read at once.
COUNTED_WORDS, READ_BYTES = 4_000_000, 4_000_000
WEIGHT_CHUNK = 1024
#: What a word's last letters stand before.
AFTER_WORD = b".,;:!?\"')]"

OWN = CLASSES * CLASS_WORDS
END = 0


def runs_of(batches: Iterator[pa.RecordBatch], most: int = READ_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``text``, or of one longer text."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy() + np.int64(1))
        at = 0
        while at < len(upto):
            before = int(upto[at - 1]) if at else 0
            end = int(np.searchsorted(upto, before + most - size, "right"))
            if end <= at and held:
                yield from out()
                held, size = [], 0
                continue
            end = max(end, at + 1)
            held.append(batch.slice(at, end - at))
            size, at = size + int(upto[end - 1]) - before, end
    if held:
        yield from out()


def words_in(said: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words as bytes, A-Z lower-cased, text after text, and how many each text has.

    Arrow's ASCII white space is exactly space and 09-0D.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(said))
    words, sizes = split.flatten().cast(pa.binary()), split.value_lengths().to_numpy()
    full = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends leaves an empty word
    if not full.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        words = words.filter(pa.array(full))
    return words, sizes


def rare_class(word: bytes) -> int:
    if word[-2:].isalnum():  # ASCII: nothing to decode or to strip
        return zlib.crc32(word[-2:]) % RARE_CLASSES
    letters = word[-24:].decode("utf-8", "ignore").rstrip(AFTER_WORD.decode())
    return zlib.crc32(letters[-2:].encode()) % RARE_CLASSES


def classes_by_ending() -> np.ndarray:
    """The rare class by a word's last two bytes (256 * the one + the other), -1 where ``rare_class`` reads other bytes."""
    two = [bytes(divmod(k, 256)) for k in range(1 << 16)]
    return np.array([zlib.crc32(x) % RARE_CLASSES if x.isascii() and x[1] not in AFTER_WORD else -1 for x in two], np.int16)


def rare_classes(words: pa.Array, by_ending: np.ndarray) -> np.ndarray:
    """``rare_class`` of every word."""
    out = np.full(len(words), -1, np.int16)
    if len(words) and words.buffers()[2]:
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        letters, marks = np.frombuffer(words.buffers()[2], np.uint8), np.zeros(256, bool)
        marks[list(AFTER_WORD)] = True
        start, end = ends[:-1], ends[1:].copy()
        for _ in range(4):
            end -= marks[letters[end - 1]] & (end > start)
        two = np.flatnonzero(end - start > 1)
        out[two] = by_ending[letters[end[two] - 2].astype(np.int64) * 256 + letters[end[two] - 1]]
    rest = np.flatnonzero(out < 0)
    out[rest] = [rare_class(w) for w in words.take(pa.array(rest)).to_pylist()]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes), ``c``: how often each word occurs, summed in the workers first. The empty word counts texts' ends."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def out(held: list[pa.Array], ends: int) -> pa.RecordBatch:
        counts = pa.chunked_array(held, pa.binary()).value_counts()
        return to_batch(schema, [
            pa.concat_arrays([counts.field(0), pa.array([b""], pa.binary())]), pa.concat_arrays([counts.field(1), pa.array([ends], pa.int64())]),
        ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for batch in runs_of(batches):
            held.append(words_in(batch.column(1))[0])
            size, ends = size + len(held[-1]), ends + batch.num_rows
            if size > COUNTED_WORDS:
                yield out(held, ends)
                held, size, ends = [], 0, 0
        yield out(held, ends)

    return docs.mapInArrow(run, "word binary, c bigint").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What a worker knows of words: counts of the frequent ones, and each one's place in the model."""

    def __init__(self, top: list[tuple[bytes, int]], ends: int, total: int, distinct: int, rare: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.words, self.by_ending = pa.array([w for w, _ in top], pa.binary()), classes_by_ending()
        counts = np.array([c for _, c in top] + [ends], np.float64)
        below = total + 0.5 * (distinct + 1)
        self.base = np.log10((counts + 0.5) / below)
        self.unseen_base = float(np.log10(0.5 / below))
        self.end_known = ends > 0
        self.below = np.array([n + 0.5 * (v + 1) for n, v in (rare.get(k, (0, 0)) for k in range(RARE_CLASSES))])
        # Model ids: END, the most frequent words, then the rare classes. END is the last place here.
        own = OWN - 1
        self.model = np.array(
            [1 + k if k < own else OWN + rare_class(w) for k, (w, _) in enumerate(top)] + [END], np.int16
        )
        self.inside = np.zeros(len(counts))
        far = self.model >= OWN
        self.inside[far] = np.log10((counts[far] + 0.5) / self.below[self.model[far] - OWN])
        self.own_counts = np.zeros(OWN)
        self.own_counts[0] = ends
        self.own_counts[1 : 1 + min(own, len(top))] = counts[: min(own, len(top))]
        self.class_counts = np.concatenate([self.own_counts.reshape(CLASSES, CLASS_WORDS).sum(1), [rare.get(k, (0, 0))[0] for k in range(RARE_CLASSES)]])

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From ``vars``: broadcasts hold plain data, so workers need no copy of the package."""
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def read(self, said: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of all texts together: model ids (END after each text), tokens of each text, places (-1: not
        among the frequent words), and the words without a place with their rare classes."""
        words, sizes = words_in(said)
        sizes = sizes + 1
        inner = np.ones(len(words) + len(sizes), bool)
        inner[np.cumsum(sizes) - 1] = False
        place = np.full(len(inner), len(self.model) - 1, np.int32)
        found = pc.index_in(words, value_set=self.words)
        place[inner] = found.fill_null(-1).to_numpy()
        other = words.filter(found.is_null())
        kinds = rare_classes(other, self.by_ending)
        ids = self.model[place]
        ids[place < 0] = OWN + kinds
        return ids, sizes, place, other, kinds

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """One text's model ids, places, and words without a place."""
        ids, _, place, other, _ = self.read(pa.array([text], pa.string()))
        return ids, place, other.to_pylist()


def frequent_words(counts: DataFrame) -> DataFrame:
    """The words of up to ``TOP_BYTES`` bytes whose count is so high that at most ``TOP_WORDS`` reach it.

    The count is read from two histograms, of steps of an eighth of a doubling and of the
    counts inside the step in which the words would become too many.
    """
    short = counts.where((F.octet_length("word") > 0) & (F.octet_length("word") <= TOP_BYTES)).withColumn("step", F.floor(8 * F.log2("c")))
    steps = sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    have, least = 0, None
    for step, n in steps:
        if have + n > TOP_WORDS:
            inside = short.where(F.col("step") == step).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
            for c, more in sorted(inside.collect(), reverse=True):
                if have + more > TOP_WORDS:
                    break
                have, least = have + more, c
            else:
                continue
            return short.where(F.col("c") >= least) if least else short.limit(0)
        have += n
        least = math.ceil(2 ** (step / 8))
    return short


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals over all counted words; the frequent words, by (count, word)."""
    total, distinct, ends = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))
    ).first()
    found = frequent_words(counts).collect()
    top = sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda x: (-x[1], x[0]))
    own, by_ending = pa.array([w for w, _ in top[: OWN - 1]] + [b""], pa.binary()), classes_by_ending()
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, RARE_CLASSES), np.int64)
        for batch in batches:
            far = pc.invert(pc.is_in(batch.column(0), value_set=own))
            kinds = rare_classes(batch.column(0).filter(far), by_ending)
            np.add.at(sums[0], kinds, batch.column(1).filter(far).to_numpy())
            sums[1] += np.bincount(kinds, minlength=RARE_CLASSES)
        yield to_batch(schema, [list(range(RARE_CLASSES)), sums[0], sums[1]])

    by_class = counts.mapInArrow(run, "k int, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    return Vocabulary(top, ends, total, distinct, {r["k"]: (r["n"], r["v"]) for r in by_class})


SHAPES = {
    "inputs": (OWN + RARE_CLASSES, 3 * HIDDEN), "recurrent": (HIDDEN, 3 * HIDDEN),
    "to_class": (HIDDEN, CLASSES + RARE_CLASSES), "class_bias": (CLASSES + RARE_CLASSES,),
    "to_word": (CLASSES, HIDDEN, CLASS_WORDS), "word_bias": (CLASSES, CLASS_WORDS),
}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES]).astype(np.float32)


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = values[at : at + size].reshape(shape)
        at += size
    return out


def first_weights(vocabulary: Vocabulary, seed: int = 5) -> np.ndarray:
    """Random recurrence, and biases that give each token its share of the corpus."""
    rng = np.random.default_rng(seed)
    weights = {k: np.zeros(s) for k, s in SHAPES.items()}
    weights["inputs"] = rng.normal(0, 0.3, SHAPES["inputs"])
    weights["inputs"][:, :HIDDEN] += 1.0  # remember by default
    weights["recurrent"] = rng.normal(0, 0.5 / np.sqrt(HIDDEN), SHAPES["recurrent"])
    weights["to_class"] = rng.normal(0, 0.01, SHAPES["to_class"])
    weights["to_word"] = rng.normal(0, 0.01, SHAPES["to_word"])
    weights["class_bias"] = np.log(vocabulary.class_counts + 0.5)
    # A place that no word has keeps next to no share.
    own = vocabulary.own_counts
    weights["word_bias"] = np.where(own > 0, np.log(np.maximum(own, 1)), -30.0).reshape(CLASSES, CLASS_WORDS)
    weights["word_bias"][0, 0] = np.log(own[0] + 0.5)
    weights["class_bias"] -= weights["class_bias"].max()
    weights["word_bias"] -= weights["word_bias"].max(1, keepdims=True)
    return flat(weights)


def _columns(x: np.ndarray) -> np.ndarray:
    """The same array with each column of its last two axes in one piece: a step's gates are then whole blocks of memory."""
    return np.ascontiguousarray(x.swapaxes(-1, -2)).swapaxes(-1, -2)


def _step(gates: np.ndarray, h: np.ndarray, recurrent: np.ndarray):
    """One step: new state, update and reset gates, candidate and its recurrent part."""
    a = np.matmul(h, recurrent, out=np.empty_like(gates, np.result_type(h, recurrent)))  # laid out as the gates are
    zr = gates[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
    zr *= 0.5  # the logistic function, as 0.5 * tanh(0.5 * x) + 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    back = a[:, 2 * HIDDEN :]
    n = r * back
    n += gates[:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, back


def _softmax(x: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of one entry of each row."""
    found = x[np.arange(len(x)), at]
    return found - np.log(np.exp(x, out=x).sum(1))


def _class_of(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens < OWN, tokens // CLASS_WORDS, CLASSES + tokens - OWN).astype(np.int16)


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The tokens with a word of their own, class after class, and each class's stretch of them."""
    order = np.argsort(kind, kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    return order[: cuts[-1]], [(k, slice(*cuts[k : k + 2])) for k in range(CLASSES) if cuts[k] < cuts[k + 1]]


def _word_logits(weights: dict, states: np.ndarray, classes: list[tuple[int, slice]]) -> np.ndarray:
    out = np.empty((len(states), CLASS_WORDS), np.result_type(states, weights["to_word"]))
    for k, at in classes:
        np.matmul(states[at], weights["to_word"][k], out=out[at])
        out[at] += weights["word_bias"][k]
    return out


def log_probabilities(weights: dict, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's class and, for words of their own, of the word in it."""
    kind = _class_of(tokens)
    out = _log_share(states @ weights["to_class"] + weights["class_bias"], kind)
    own, classes = _by_class(kind)
    out[own] += _log_share(_word_logits(weights, states.take(own, 0), classes), tokens[own] % CLASS_WORDS)
    return out


def gradients(weights: dict, before: np.ndarray, tokens: np.ndarray, h: np.ndarray):
    """Backpropagation through one window: summed gradients and the state after it.

    ``before``, ``tokens``: steps x streams. A stream whose token before is END starts a
    document there, with an empty state.
    """
    steps, streams = tokens.shape
    gates, start = weights["inputs"].take(before, 0), before == END
    starts = start.any(1).tolist()
    states, kept = np.empty((steps, streams, HIDDEN), np.float32), np.empty((5, steps, streams, HIDDEN), h.dtype)
    for t in range(steps):
        if starts[t]:
            h = h.copy()
            h[start[t]] = 0
        kept[0, t] = h
        states[t], kept[1, t], kept[2, t], kept[3, t], kept[4, t] = step = _step(gates[t], h, weights["recurrent"])
        h = step[0]
    flat_states, flat_tokens = states.reshape(-1, HIDDEN), tokens.ravel()
    kind = _class_of(flat_tokens)
    rows = np.arange(len(kind))
    grad = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    p = _softmax(flat_states @ weights["to_class"] + weights["class_bias"])
    p[rows, kind] -= 1
    grad["to_class"], grad["class_bias"] = flat_states.T @ p, p.sum(0)
    down = p @ weights["to_class"].T
    own, classes = _by_class(kind)
    mine = flat_states.take(own, 0)
    p = _softmax(_word_logits(weights, mine, classes))
    p[np.arange(len(own)), flat_tokens[own] % CLASS_WORDS] -= 1
    more = np.empty_like(mine, dtype=down.dtype)
    for k, at in classes:
        grad["to_word"][k], grad["word_bias"][k] = mine[at].T @ p[at], p[at].sum(0)
        np.matmul(p[at], weights["to_word"][k].T, out=more[at])
    down[own] += more
    down = down.reshape(steps, streams, HIDDEN)
    later = np.zeros((streams, HIDDEN), np.float32)
    into = np.empty((steps, streams, 3 * HIDDEN), np.float32)
    was, z, r, n, back = kept
    # What doesn't depend on later steps, for all steps at once.
    apart, not_z, not_r, slope = was - n, 1 - z, 1 - r, 1 - n * n
    through, turned = np.empty((streams, 3 * HIDDEN), h.dtype), weights["recurrent"].T
    dz, dr, dnr = (through[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
    for t in reversed(range(steps)):
        dh = down[t] + later
        dn = dh * not_z[t]
        dn *= slope[t]
        np.multiply(dh, apart[t], out=dz)
        dz *= z[t]
        dz *= not_z[t]
        np.multiply(dn, back[t], out=dr)
        dr *= r[t]
        dr *= not_r[t]
        np.multiply(dn, r[t], out=dnr)
        into[t, :, : 2 * HIDDEN] = through[:, : 2 * HIDDEN]
        into[t, :, 2 * HIDDEN :] = dn
        grad["recurrent"] += was[t].T @ through
        dh *= z[t]
        dh += through @ turned
        later = dh
        if starts[t]:
            later[start[t]] = 0
    order = np.argsort(before.ravel(), kind="stable")
    used = before.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
    grad["inputs"][used[first]] = np.add.reduceat(into.reshape(-1, 3 * HIDDEN).take(order, 0), first, axis=0)
    return grad, h


class Trainer:
    """Adam over windows of side-by-side streams of documents."""

    def __init__(self, values: np.ndarray, rate: float = RATE):
        self.values, self.rate = values.astype(np.float32).copy(), rate
        self.mean, self.square, self.turn, self.tokens = np.zeros_like(self.values), np.zeros_like(self.values), 0, 0

    def feed(self, ids: np.ndarray, streams: int = STREAMS, steps: int = STEPS) -> None:
        """Documents joined to one run of tokens, each ended by END, cut into equal streams."""
        streams = max(1, min(streams, len(ids) // steps))
        length = -(-len(ids) // streams)
        padded = np.concatenate([ids, np.full(streams * length - len(ids), END, ids.dtype)])
        tokens = padded.reshape(streams, length).T
        before = np.concatenate([[END], padded[:-1]]).astype(ids.dtype).reshape(streams, length).T
        h = np.zeros((streams, HIDDEN), np.float32)
        for at in range(0, length, steps):
            part = tokens[at : at + steps]
            grad, h = gradients(shaped(self.values), before[at : at + steps], part, h)
            self.turn += 1
            g = flat(grad) / np.float32(part.size)
            self.mean += 0.1 * (g - self.mean)
            self.square += 0.005 * (g * g - self.square)
            rate = self.rate * np.sqrt(1 - 0.995**self.turn) / (1 - 0.9**self.turn)
            self.values -= np.float32(rate) * self.mean / (np.sqrt(self.square) + np.float32(1e-7))
            for name, value in shaped(self.values).items():
                if name.startswith("to_"):
                    np.clip(value, -MOST_WEIGHT, MOST_WEIGHT, out=value)
                elif name.endswith("bias"):
                    np.minimum(value, MOST_BIAS, out=value)
        self.tokens += len(ids)


def train(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights learned from all documents, each seen once.

    In every round each partition trains on its documents from the round's common weights;
    the results, weighted by tokens, are averaged in pieces by Spark. A partition's result
    depends on its rows alone. Without documents the first weights stay.
    """
    spark = docs.sparkSession
    values, known = first_weights(vocabulary), spark.sparkContext.broadcast(vars(vocabulary))
    schema = pa.schema([("piece", pa.int32()), ("tokens", pa.int64()), ("sums", pa.list_(pa.float64()))])
    ddl = "piece int, tokens bigint, sums array<double>"
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS[-1][1]))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for piece, n, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                have = total.setdefault(piece, [0, 0.0])
                have[0] += n
                have[1] = have[1] + sums.values.to_numpy()
        for piece, (n, sums) in total.items():
            yield to_batch(schema, [[piece], [n], pa.array([sums], pa.list_(pa.float64()))])

    for low, high in ROUNDS:
        start = spark.sparkContext.broadcast(values)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            trainer, vocabulary, held, size = Trainer(start.value), Vocabulary.of(known.value), [], 0
            for batch in runs_of(batches):
                ids, sizes, *_ = vocabulary.read(batch.column(1))
                for own in np.split(ids, np.cumsum(sizes)[:-1]):
                    held.append(own)
                    size += len(own)
                    if size > CHUNK_TOKENS:
                        trainer.feed(np.concatenate(held))
                        held, size = [], 0
            if held:
                trainer.feed(np.concatenate(held))
            if trainer.tokens:
                for piece, at in enumerate(range(0, len(trainer.values), WEIGHT_CHUNK)):
                    sums = trainer.values[at : at + WEIGHT_CHUNK].astype(np.float64) * trainer.tokens
                    yield to_batch(schema, [[piece], [trainer.tokens], pa.array([sums], pa.list_(pa.float64()))])

        found = docs.where((part >= low) & (part < high)).mapInArrow(run, ddl).repartition(spread, "piece").mapInArrow(add, ddl).collect()
        if found:
            values = np.concatenate([np.array(r["sums"]) / r["tokens"] for r in sorted(found, key=lambda r: r["piece"])]).astype(np.float32)
    return values


def side_by_side(sizes: list[int], streams: int) -> list[list[int]]:
    """Documents dealt to streams, longest first, each to the shortest stream."""
    heap = [(0, k) for k in range(min(streams, len(sizes)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for doc in sorted(range(len(sizes)), key=lambda d: -sizes[d]):
        size, k = heapq.heappop(heap)
        dealt[k].append(doc)
        heapq.heappush(heap, (size + sizes[doc], k))
    return sorted(dealt, key=lambda docs: -sum(sizes[d] for d in docs))


def score_documents(weights: dict, docs: list[np.ndarray], streams: int = SCORE_STREAMS, steps: int = SCORE_STEPS) -> np.ndarray:
    """Natural log probability of each whole document; the state is carried from window to window."""
    sizes = [len(d) for d in docs]
    dealt = side_by_side(sizes, streams)
    lengths = np.array([sum(sizes[d] for d in own) for own in dealt])
    tokens = np.full((lengths.max(), len(dealt)), END, np.int16)
    for k, own in enumerate(dealt):
        tokens[: lengths[k], k] = np.concatenate([docs[d] for d in own])
    before = np.concatenate([np.full((1, len(dealt)), END, np.int16), tokens[:-1]])
    logs = np.zeros(tokens.shape, np.float32)
    h = np.zeros((len(dealt), HIDDEN), np.float32)
    for at in range(0, len(tokens), steps):
        live = int((lengths > at).sum())  # streams are sorted by length
        part = tokens[at : at + steps, :live]
        gates, start = weights["inputs"].take(before[at : at + steps, :live], 0), before[at : at + steps, :live] == END
        gates, h, starts = _columns(gates), _columns(h[:live]), start.any(1).tolist()
        states = np.empty((len(part), HIDDEN, live), np.float32).swapaxes(1, 2)
        for t in range(len(part)):
            if starts[t]:
                np.copyto(h, 0, where=start[t][:, None])
            h = _step(gates[t], h, weights["recurrent"])[0]
            states[t] = h
        logs[at : at + steps, :live] = log_probabilities(weights, states.reshape(-1, HIDDEN), part.ravel()).reshape(part.shape)
    out = np.zeros(len(docs))
    for k, own in enumerate(dealt):
        ends = np.cumsum([sizes[d] for d in own])
        sums = np.add.reduceat(logs[: lengths[k], k].astype(np.float64), np.concatenate([[0], ends[:-1]]))
        out[own] = sums
    return out


def score_texts(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    ``training``: which rows to learn from, a condition on ``doc_id`` and ``text``. Scores are
    log10 of the whole text's probability under the unigram base and under the model. A word's
    probability in the model is that of its class given all before it, times that of the word
    in the class: a softmax for the frequent words, the smoothed share of the corpus counts
    for the others. Counts, classes' totals and weights are learned from all training rows.

    Counts of frequent words go to every worker (a bounded list); all other words meet their
    counts in a join. NULL, empty and blank texts are one END. Repeated rows and NULL ids come
    back as they are. Without training rows every token's base share is 1 / (0 + 1).
    """
    spark = docs.sparkSession
    small_batches(spark)
    said = texts(docs, key=key, text=text)
    learn = said.where(training)
    counts = checkpointed(word_counts(learn))
    vocabulary = learn_vocabulary(counts)
    values = train(learn, vocabulary)
    known, given = spark.sparkContext.broadcast(vars(vocabulary)), spark.sparkContext.broadcast(values)
    names = ["doc_id", "row_1", "row_2", "n_tokens", "n_known"]
    other = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32()), ("n", pa.int64())]))
    schema = pa.schema([*((n, pa.int64()) for n in names), ("base_score", pa.float64()), ("score", pa.float64()), ("other", other)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weights = Vocabulary.of(known.value), shaped(given.value)
        for batch in runs_of(batches):
            ids, sizes, place, words, kinds = v.read(batch.column(1))
            ends, seen = np.cumsum(sizes), place >= 0
            sums = [np.add.reduceat(x, ends - sizes) for x in (seen.astype(np.int64), np.where(seen, v.base[place], 0), np.where(seen, v.inside[place], 0))]
            logs = score_documents(weights, np.split(ids, ends[:-1])) / np.log(10)
            # A text's words without a place, each with how often the text has it.
            coded, row = words.dictionary_encode(), np.searchsorted(ends, np.flatnonzero(~seen), "right")
            codes, many = coded.indices.to_numpy(), max(1, len(coded.dictionary))
            kind = np.zeros(many, np.int32)
            kind[codes] = kinds
            pairs, n = np.unique(row * many + codes, return_counts=True)
            each = pa.StructArray.from_arrays(
                [coded.dictionary.take(pa.array(pairs % many)), pa.array(kind[pairs % many]), pa.array(n, pa.int64())], fields=list(other.value_type)
            )
            starts = np.searchsorted(pairs, np.arange(len(sizes) + 1) * many).astype(np.int32)
            yield to_batch(schema, [
                batch.column(0), batch.column(2), batch.column(3), sizes, sums[0] - (not v.end_known), sums[1], sums[2] + logs,
                pa.ListArray.from_arrays(pa.array(starts), each, type=other),
            ])

    ddl = ", ".join(f"{n} bigint" for n in names) + ", base_score double, score double, other array<struct<word:binary,k:int,n:bigint>>"
    keyed = texts(docs, *row_key(docs, key, text), key=key, text=text)
    part = checkpointed(keyed.mapInArrow(run, ddl))
    row = ["row_1", "row_2"]
    rare = part.where(F.size("other") > 0).dropDuplicates(row).select(*row, F.explode("other").alias("o")).select(*row, "o.*")
    below = F.element_at(F.array(*[F.lit(float(x)) for x in vocabulary.below]), F.col("k") + 1)
    all_below = float(vocabulary.total + 0.5 * (vocabulary.distinct + 1))
    c = F.coalesce("c", F.lit(0))
    found = rare.join(counts, "word", "left").groupBy(*row).agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / all_below)).alias("more_base"),
        F.sum(F.col("n") * F.log10((c + 0.5) / below)).alias("more_score"),
    )
    more = lambda name: F.coalesce(name, F.lit(0))
    return part.drop("other").join(found, row, "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more("more_base")).alias("base_score"), (F.col("score") + more("more_score")).alias("score"),
    )
