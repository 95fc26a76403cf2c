"""Byte-level BPE: texts to token ids with offsets, and ids back to bytes and text."""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from feedproj.llm.common import Aged, by_bytes, kept_in_worker, lists, one_thread_each, texts, to_batch

#: Bytes a worker's memory of encoded pieces takes, in each of its two halves.
REMEMBERED = 24_000_000
#: Characters of text a worker cuts into pieces at once (at least one text).
CHARS = 1_000_000
#: Below this code point the regex module and the tokenizers library class characters alike.
SAME_CLASSES_BELOW = 0x530


def read_ranks(spark: SparkSession | None, path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte value.

    Printable bytes of Latin-1 stand for themselves, the rest follow from U+0100 on.
    """
    # The ranges of bytes that stand for themselves, and the first spare character.
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``, found by merging with the lower ranks only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def model_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers model with the vocabulary and merge order of ``ranks``, for whole pieces."""
    chars = byte_chars()
    said = lambda token: "".join(chars[b] for b in token)
    by_rank = sorted(ranks, key=ranks.__getitem__)
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [],
        "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None,
        "model": {
            "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
            "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
            "vocab": {said(t): ranks[t] for t in by_rank},
            "merges": [[said(x) for x in merge_pair(t, ranks)] for t in by_rank if len(t) > 1],
        },
    })


class Encoder:
    """Cuts a text into pieces and encodes each distinct piece once."""

    def __init__(self, model: str, pattern: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        one_thread_each()
        self.bpe = Tokenizer.from_str(model).encode_batch_fast
        self.cut = regex.compile(pattern).findall
        self.odd = regex.compile(f"[^\\x00-{chr(SAME_CLASSES_BELOW - 1)}]").search
        self.split = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str
        self.chars = byte_chars()
        self.known = Aged(REMEMBERED)

    def pieces(self, text: str) -> list[str]:
        if self.odd(text):
            return [piece for piece, _ in self.split(text)]
        return self.cut(text)

    def encode(self, pieces: list[str]) -> Iterator[bytes]:
        """The pieces' ids, in calls of a few thousand, each byte said by its character."""
        chars = self.chars
        for at in range(0, len(pieces), 4096):
            said = ["".join([chars[b] for b in piece.encode()]) for piece in pieces[at : at + 4096]]
            for got in self.bpe(said, add_special_tokens=False):
                yield np.array(got.ids, np.int32).tobytes()

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for part in by_bytes(texts, CHARS):
            cut = [self.pieces(x) for x in part]
            known = self.known.learn(set().union(*cut), self.encode)
            out += [np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32) for x in cut]
        return out


def spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token; a token inside a character spans all of it.

    ``sizes`` has the bytes of each id. Byte positions are mapped to characters by the
    lead bytes of the text's UTF-8 form.
    """
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    char_of = np.cumsum(lead) - 1
    ends = np.cumsum(sizes[ids])
    if not len(ids):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return char_of[ends - sizes[ids]].astype(np.int32), (char_of[ends - 1] + 1).astype(np.int32)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = True,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id``, ``ids`` and, if ``offsets``, ``starts`` and ``ends`` (characters) of each token.

    Every match of ``pattern`` is encoded by itself; there are no special tokens. NULL and
    empty texts have no tokens. One output row for each input row: repeated rows and NULL
    ids come back as they are. The vocabulary travels as a broadcast, whose size is that of
    the ranks file; a worker remembers encoded pieces up to ``REMEMBERED`` bytes, from one
    task to the next.
    """
    ranks = read_ranks(docs.sparkSession, ranks_path)
    model = docs.sparkSession.sparkContext.broadcast(model_json(ranks))
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    sizes = docs.sparkSession.sparkContext.broadcast(length)
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    if offsets:
        fields += [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
    schema = pa.schema(fields)
    name = encoder_name(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(name, lambda: Encoder(model.value, pattern))
        none = np.zeros(0, np.int32)
        for batch in batches:
            said = batch.column(1).to_pylist()
            ids = encoder.batch(said)
            sizes_of = [len(x) for x in ids]
            out = [batch.column(0), lists(np.concatenate([none, *ids]), sizes_of)]
            if offsets:
                at = [spans(x, i, sizes.value) for x, i in zip(said, ids, strict=True)]
                out += [lists(np.concatenate([none, *[a[k] for a in at]]), sizes_of) for k in (0, 1)]
            yield to_batch(schema, out)

    ddl = "doc_id bigint, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return texts(docs, key=key, text=text).mapInArrow(run, ddl)


def encoder_name(ranks: dict[bytes, int], pattern: str) -> str:
    """Names what a worker keeps by what it is made of."""
    said = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        said.update(b"%d %s\n" % (rank, token))
    return f"bpe_{said.hexdigest()}"


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decoded(ids: np.ndarray, ends: np.ndarray, table: list[bytes]) -> list[bytes]:
    """The bytes of each run of ``ids`` that stops at one of ``ends``."""
    token, flat = table.__getitem__, ids.tolist()
    return [b"".join(map(token, flat[a:b])) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (bytes) of each row: :func:`encode` and :func:`decode` in one pass.

    One Python worker for each task holds one tokenizer and one table, and texts, ids and
    bytes are there for ``CHARS`` characters at a time (or one longer text). The same cases
    as in the two functions hold.
    """
    ranks = read_ranks(docs.sparkSession, ranks_path)
    name = encoder_name(ranks, pattern)
    shared = docs.sparkSession.sparkContext.broadcast((model_json(ranks), token_table(ranks)))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(name, lambda: Encoder(shared.value[0], pattern))
        table = kept_in_worker(f"{name}_table", lambda: shared.value[1])
        for batch in batches:
            at = 0
            for part in by_bytes(batch.column(1).to_pylist(), CHARS):
                ids = encoder.batch(part)
                flat, sizes = np.concatenate(ids), [len(x) for x in ids]
                got = decoded(flat, np.cumsum(sizes), table)
                yield to_batch(schema, [batch.column(0).slice(at, len(part)), lists(flat, sizes), pa.array(got, pa.binary())])
                at += len(part)

    return texts(docs, key=key, text=text).mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` (bytes) and ``decoded_text`` of each row of token ids.

    Ids are joined as bytes before any character is read, so a character split over tokens
    comes back whole; bytes that are no UTF-8 (a sequence cut inside a character) stay in
    ``decoded`` and show as U+FFFD in ``decoded_text``. NULL ids decode to nothing; an id
    outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(token_table(read_ranks(encoded.sparkSession, ranks_path)))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary()), ("decoded_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            if column.null_count:
                column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
            ends = column.offsets.to_numpy()
            got = decoded(column.flatten().to_numpy(), ends[1:] - ends[0], shared.value)
            yield to_batch(schema, [batch.column(0), column, pa.array(got, pa.binary()), [x.decode("utf-8", "replace") for x in got]])

    from pyspark.sql import functions as F

    return encoded.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{ids}`").cast("array<int>").alias("ids")
    ).mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary, decoded_text string")


class StreamDecoder:
    """Decodes ids that arrive in pieces; holds back a character until its last byte is there."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        return self.decoder.decode(b"".join(map(self.table.__getitem__, ids)), last)
