"""Each operator against a plain version of its rules, on the driver's and on special documents."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokens
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedproj import session
from feedproj.llm import (
    byte_bpe,
    chat_format,
    common,
    jaccard_join,
    language_model,
    lattice_dedup,
    line_dedup,
    packing,
    passage_dedup,
    quality_rules,
    toxicity,
)

SPACE = " \t\n\x0b\x0c\r"
RANKS = tokens.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def closure(nodes, links):
    groups = common.Groups()
    for a, b in links:
        groups.join(a, b)
    return {n: groups.find(n) for n in nodes}


# --- byte BPE -----------------------------------------------------------------------------


def test_byte_bpe(table):
    import tiktoken

    ranks = byte_bpe.read_ranks(None, RANKS)
    plain = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(table, RANKS, tokens.PATTERN)
    want = Counter((d, tuple(plain.encode_ordinary(t))) for d, t in pairs(table))
    rows = encoded.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    texts = Counter((r["doc_id"], bytes(r["decoded"]).decode(), r["decoded_text"]) for r in byte_bpe.decode(encoded, RANKS).collect())
    assert texts == Counter((d, t, t) for d, t in pairs(table))
    by_id = dict(pairs(table))
    for r in rows[:60]:
        if r["doc_id"] is not None:
            _, starts = plain.decode_with_offsets(r["ids"])
            assert list(r["starts"]) == starts
            assert not r["ends"] or r["ends"][-1] == len(by_id[r["doc_id"]])


def test_byte_bpe_split_characters(spark):
    table = {v: k for k, v in byte_bpe.read_ranks(None, RANKS).items()}
    ids = byte_bpe.Encoder(byte_bpe.model_json({v: k for k, v in table.items()}), tokens.PATTERN).batch(["né\U0001f600x"])[0].tolist()
    decoder = byte_bpe.StreamDecoder([table[k] for k in range(len(table))])
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], last=True) == "né\U0001f600x"
    cut = spark.createDataFrame([(1, ids[:-2]), (2, None)], "doc_id bigint, ids array<int>")
    found = {r["doc_id"]: r["decoded_text"] for r in byte_bpe.decode(cut, RANKS).collect()}
    assert found[1].startswith("né") and "�" in found[1] and found[2] == ""


# --- lines --------------------------------------------------------------------------------


def test_line_dedup(table):
    docs = pairs(table)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for d, t in docs:
        for line in t.split("\n"):
            if d is not None and len(line.strip(SPACE)) >= 10:
                holders[key(line)].add(d)
    want = Counter()
    for d, t in docs:
        lines = t.split("\n")
        gone = [d is not None and len(h := holders.get(key(x), ())) > 1 and d > min(h) for x in lines]
        want[(d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))] += 1
    got = line_dedup.dedup_lines(table).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter(tuple(r) for r in got) == want
    plan = line_dedup.dedup_lines(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_keeps_columns(docs):
    out = line_dedup.filtered(docs)
    assert out.schema == docs.schema or out.columns == docs.columns
    assert out.count() == docs.count()
    assert out.where("doc_id = 3").first()["text"] is None


# --- Jaccard join -------------------------------------------------------------------------


def jaccard(docs, size, percent):
    sets = {}
    for d, t in docs:
        w = words(t.translate(LOWER))
        k = min(size, len(w))
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    flat = [(d, s) for d, own in sets.items() if d is not None for s in own if s]
    links = [
        (a, b) for i, (a, x) in enumerate(flat) for b, y in flat[:i]
        if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y)
    ]
    comp = closure([d for d in sets if d is not None], links)
    return Counter((d, len(s), comp.get(d)) for d, own in sets.items() for s in own)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(table, size, percent):
    got = jaccard_join.link_documents(table, size, percent).collect()
    assert Counter(tuple(r) for r in got) == jaccard(pairs(table), size, percent)


def near_copies(n=60, length=120, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"v{k}" for k in rng.integers(0, 5000, length)]
    rows = []
    for d in range(n):
        own = list(base)
        for k in rng.integers(0, length, 1 + d % 5):
            own[k] = f"u{rng.integers(0, 40)}"
        rows.append((int(rng.permutation(n)[0]) * 1000 + d, " ".join(own)))
    return rows


def test_jaccard_join_group_of_near_copies(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = jaccard(rows, 3, 90)
    assert len({c for _, _, c in want}) > 1 and max(Counter(c for _, _, c in want).values()) > 5
    for piece in (1024, 7):
        monkeypatch.setattr(jaccard_join, "PIECE", piece)
        for limit in ("THINNED", "HELD"):  # lists that stay whole, workers that hold a few rows
            monkeypatch.setattr(jaccard_join, limit, piece)
        assert Counter(tuple(r) for r in jaccard_join.link_documents(docs, 3, 90).collect()) == want


def test_bitmaps_of_different_sizes():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (5, 300, 900, 1000, 9000)]
    sets.append(np.concatenate([sets[3][:-40], sets[2][:10]]))
    sizes = [jaccard_join.places(len(x), 90) for x in sets]
    assert sizes == sorted(sizes[:-1]) + [sizes[3]] and sizes[0] == 128 and sizes[4] == 2048
    bits = jaccard_join.Bitmaps(pa.chunked_array([pa.array([jaccard_join.bitmap(x, n) for x, n in zip(sets, sizes, strict=True)], pa.list_(pa.int64()))]))
    for a, one in enumerate(sets):
        for b, other in enumerate(sets):
            size = min(sizes[a], sizes[b])
            plain = np.bitwise_count((jaccard_join.bitmap(one, size) ^ jaccard_join.bitmap(other, size)).view(np.uint64)).sum()
            assert bits.apart(np.array([a]), np.array([b]))[0] == plain <= len(np.setxor1d(one, other))


def test_jaccard_filtered(docs):
    out = jaccard_join.filtered(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(9) == 0 and 8 in ids and 6 in ids and 7 not in ids and None in ids and {3, 4, 5} <= set(ids)


def test_components_in_rounds(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + k, 1001 + k) for k in range(40)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    want = closure({x for p in links if p[0] != p[1] for x in p}, [p for p in links if p[0] != p[1]])
    for one_task in (1_000_000, 0):
        assert {r["id"]: r["component_id"] for r in common.components(df, one_task).collect()} == want


# --- packing ------------------------------------------------------------------------------


def test_packing(table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.path("word_bpe_49k.json"))
    out = packing.pack(packing.cut(table, tokens.path("word_bpe_49k.json")), block=100).collect()
    want = Counter()
    for d, t in pairs(table):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[(d, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in out) / 2048) * 1.03 + 3


def test_local_search_empties_bins():
    rng = np.random.default_rng(4)
    saved = 0
    for _ in range(30):
        sizes = rng.integers(1, 1500, 60).tolist()
        first = packing.best_fit(sizes, 2048)
        better = packing.improve([list(b) for b in first], sizes, 2048)
        assert sorted(i for b in better for i in b) == list(range(60))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in better)
        saved += len(first) - len(better)
        assert len(better) <= len(first)
    # Best fit needs four bins of ten here: 6, 5, 5, 4 + 4, 3 ... an exchange finds three.
    sizes = [5, 5, 4, 3, 3, 4, 2, 2, 2]
    worse = [[0, 2], [1, 5], [3, 4, 6], [7, 8]]
    assert len(packing.improve(worse, sizes, 10)) == 3


# --- quality ------------------------------------------------------------------------------


def test_quality_rules(table):
    got = quality_rules.judge(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = Counter()
    for d, t in pairs(table):
        w = words(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        want[(d, *n, len(w) < 20 or 100 * len(covered) > 30 * len(w))] += 1
    assert Counter(tuple(r) for r in got) == want


def test_host_verdicts(spark):
    good = "a quite ordinary sentence of words that says this and that about nothing at all in particular for number {} today"
    rows = [(k, good.format(k), f"fine{k % 5}") for k in range(200)]
    rows += [(1000 + k, "too short", "bad") for k in range(60)] + [(1100 + k, good.format(k), "bad") for k in range(5)]
    rows += [(2000, "short", "once"), (2001, good.format(1), "once"), (2002, good.format(2), None)]
    out = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(out[k]["kept"] for k in range(200))
    assert not any(out[1100 + k]["kept"] or out[1100 + k]["base_failed"] for k in range(5))
    assert out[2001]["kept"] and out[2002]["kept"] and not out[2000]["kept"]
    assert 0.2 < out[2001]["host_rate"] < 0.5 < out[1100]["host_rate"]


# --- passages -----------------------------------------------------------------------------


def test_passages(docs):
    from conftest_llm import PASSAGE

    out = {(r["row"]["doc_id"], r["row"]["text"]): r for r in passage_dedup.remove_repeats(docs).collect()}
    by_id = {d: r for (d, _), r in out.items()}
    assert by_id[12]["kept_text"] == by_id[12]["row"]["text"] and not by_id[12]["removed"]
    left = by_id[13]["kept_text"]
    assert "committee" not in left and "lamps" not in left and left.startswith("eta theta iota.") and left.endswith("kappa lambda mu.")
    text = by_id[13]["row"]["text"]
    assert PASSAGE in "".join(text[s["start"] : s["end"]] for s in by_id[13]["removed"])
    assert by_id[3]["kept_text"] == "" and by_id[4]["kept_text"] == "" and not by_id[5]["removed"]


def test_passages_against_plain_version(table):
    docs = pairs(table)
    first = {}
    for d, t in docs:
        if d is not None:
            for *_, digest in passage_dedup.units(t):
                if digest is not None:
                    first[digest] = min(first.get(digest, d), d)
    want = Counter()
    for d, t in docs:
        repeated = {h for *_, h in passage_dedup.units(t) if d is not None and h is not None and first[h] < d}
        spans = passage_dedup.spans_to_remove(t, repeated)
        kept, at = [], 0
        for a, b in spans:
            kept.append(t[at:a])
            at = b
        want[(d, tuple(spans), "".join(kept) + t[at:])] += 1
    got = passage_dedup.remove_repeats(table).collect()
    assert Counter((r["row"]["doc_id"], tuple((s["start"], s["end"]) for s in r["removed"]), r["kept_text"]) for r in got) == want
    assert any(s for _, s, _ in want)


def test_passages_whatever_their_borders(spark):
    prose = " ".join(f"word{k * k % 971}" for k in range(60))
    lines = ". ".join(" ".join(f"term{j * 7 + k}" for k in range(7)) for j in range(9))
    han = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(60))
    pasted = [prose, lines, han]
    rows = [(k, f"own{k} before {p} own{k} after") for k, p in enumerate(pasted)]
    rows += [(10 + k, f"other{k} start here {p} other{k} end here") for k, p in enumerate(pasted)]
    rows += [(20, f"{prose} between {prose} last"), (21, prose.rsplit(" ", 11)[0] + " too short"), (None, f"{prose} between {prose}"), (40, prose), (40, "short " + "x" * 60)]
    out = {r["row"]["doc_id"]: r["kept_text"] for r in passage_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, p in enumerate(pasted):
        assert out[k] == rows[k][1]
        assert out[10 + k] == f"other{k} start here other{k} end here"
    assert out[20] == "between last" and out[21] == rows[7][1] and out[None] == f"{prose} between "


def test_passages_read_together_as_alone():
    """Texts read at once give the spans that each gives alone, in all scripts and whatever ends them."""
    prose = " ".join(f"Word{k * k % 971}" for k in range(70))
    said = [
        "", prose, "x." + prose, "\n. One two three! One two three?\n", "İstanbul ΟΔΟΣ end " + prose.lower(), "漢字かなab" * 20, "no end", "",
        " ".join(["the same eight words are said once more."] * 7), prose + "\n\n" + prose.upper() + " \ttail",
    ]
    known = [d for t in said[1:2] + said[5:6] for *_, d in passage_dedup.units(t) if d is not None]
    digests = np.frombuffer(b"".join(known), np.int64).reshape(-1, 2)
    n = len(said)
    together = list(passage_dedup.spans_of_texts(said, [digests] * n, [True] * n, 25))
    assert together == [passage_dedup.spans_to_remove(t, set(known)) for t in said]
    assert [bool(x) for x in together] == [False, True, True, False, True, True, False, False, True, True]
    assert passage_dedup.sentences(said[3]) == [(3, 17, 3, d := passage_dedup.sentences(said[3])[0][3]), (18, 32, 3, d)] and d
    half = digests.copy()
    half[:, 1] += 1
    assert not passage_dedup.held(digests, half).any() and passage_dedup.held(digests, np.concatenate([half, digests])).all()


def staged_columns(tmp_path):
    """The columns of each table in the shared folder."""
    return {f.parent: set(pq.read_schema(f).names) for f in tmp_path.glob("staged/**/*.parquet")}


def test_tables_no_later_step_reads_are_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    prose = " ".join(f"word{k * k % 971}" for k in range(60))
    docs = spark.createDataFrame([(1, prose), (2, "own " + prose), (3, "a b c"), (4, prose)], "doc_id bigint, text string")
    found = passage_dedup.remove_repeats(docs)
    assert list(staged_columns(tmp_path).values()) == [{"doc_id", "repeated", "whole"}]
    assert {r["row"]["doc_id"]: r["kept_text"] for r in found.collect()} == {1: prose, 2: "own ", 3: "a b c", 4: ""}


def test_near_copies_drop_prefixes_and_bitmaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    prose = " ".join(f"word{k * k % 971}" for k in range(60))
    docs = spark.createDataFrame([(1, prose), (2, prose + " end"), (3, "a b c"), (None, prose)], "doc_id bigint, text string")
    link = jaccard_join.link_documents(docs)
    assert sum("prefix" in x for x in staged_columns(tmp_path).values()) == 1  # that of the classes
    assert {(r["doc_id"], r["component_id"]) for r in link.collect()} == {(1, 1), (2, 1), (3, 3), (None, None)}
    before = staged_columns(tmp_path)
    kept = jaccard_join.filtered(docs)
    assert not any(x & {"prefix", "bits", "shingles", "token"} for d, x in staged_columns(tmp_path).items() if d not in before)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]


# --- embeddings ---------------------------------------------------------------------------


def plain_vectors(rows, least=0.93):
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.max(np.abs(v))
            fine[i] = (label, x / np.sqrt((x * x).sum()))
    ids = list(fine)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if fine[a][0] == fine[b][0] and len(fine[a][1]) == len(fine[b][1]) and fine[a][1] @ fine[b][1] >= least
    ]
    return links, closure([i for i, *_ in rows if i is not None], links)


def test_lattice_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    links, comp = plain_vectors(rows)
    got = {r["vec_id"]: r for r in lattice_dedup.dedup(df).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * 2 * len(links)
    assert np.mean([got[i]["component_id"] == comp[i] for i in comp]) >= 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_lattice_groups_and_special_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(k, (base + rng.normal(0, 0.05, 16)).tolist(), 1) for k in range(40)]
    rows += [(100 + k, base.tolist(), 2) for k in range(5)] + [(200, base.tolist(), None), (201, None, 1), (202, [0.0] * 16, 1)]
    rows += [(203, [float("nan")] * 16, 1), (204, [None] * 16, 1), (205, [], 1), (206, base.tolist()[:8], 1), (207, (base * 1e-200).tolist(), 2)]
    rows += [(None, base.tolist(), 2)]
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id bigint, embedding array<double>, label int, rep string, n int")
    links, comp = plain_vectors(rows)
    count = Counter(x for p in links for x in p)
    for piece in (512, 6):
        got = {r["vec_id"]: r for r in lattice_dedup.dedup(df, piece=piece).collect()}
        assert len(got) == len(rows) and got[None]["component_id"] is None
        assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in comp} == {i: (count[i], c) for i, c in comp.items()}


def test_e8_points():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (200, 8))
    p = lattice_dedup.closest(x)
    near = p[:, None] + lattice_dedup.roots()[None]
    assert len(lattice_dedup.roots()) == 240
    assert (((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - near) ** 2).sum(2) + 1e-9).all()


# --- toxicity -----------------------------------------------------------------------------


def test_toxicity_learns_and_reads_misspellings(spark):
    rng = np.random.default_rng(0)
    syllables = ["ka", "lo", "mi", "ter", "san", "vu", "re", "po", "den", "shi"]
    word = lambda: "".join(rng.choice(syllables, 3))
    texts = []
    for k in range(500):
        w = [word() for _ in range(int(rng.integers(20, 300)))]
        if k % 5 == 0:
            for _ in range(max(2, len(w) // 40)):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["grumblewort", "scoundrel!", "Nastybrain"])))
        texts.append((" ".join(w), int(k % 5 == 0)))
    model = toxicity.train(texts[:400])
    score = toxicity.Scorer(model.margins(), float(model.bias[1] - model.bias[0])).score
    right = [(score(t) >= 0.7) == y for t, y in texts[400:]]
    assert np.mean(right) >= 0.95
    clean = [t for t, y in texts[400:] if not y][0]
    assert score(clean + " scoundrell " + "grumblewortt") > score(clean)
    assert score("") == 0.0 and 0 <= score("x" * 200_000) <= 1


def test_toxicity_reads_the_middle_of_long_words():
    margins = np.zeros(toxicity.BUCKETS, np.float32)
    margins[toxicity.subwords("idiot")] = 50
    score = toxicity.Scorer(margins, 0.0).score
    for word in ("字" * 300 + "idiot" + "字" * 300, "some_thing." * 30 + "idiot" + "_ok" * 50):
        assert score(word) > score(word.replace("idiot", "")) + 0.01
    for n in range(70, 200):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        marked = f"<{word}>"
        grams = {marked[i : i + k] for k in range(toxicity.SMALLEST, toxicity.LARGEST + 1) for i in range(len(marked) - k + 1)}
        pieces = toxicity.words_of(word)
        assert pieces == [word] if n <= 80 else all(any(g in p for p in pieces) for g in grams)
        assert all(len(p) <= 81 for p in pieces)


def test_toxicity_query(spark, docs, empty, sf_dir):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (8, 0), (8, 0)], "doc_id bigint, toxic int")
    sample = toxicity.sample(docs, labels)
    assert sorted(y for _, y in sample) == [0, 0, 1]
    out = toxicity.score_toxicity(docs, toxicity.train(sample))
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score_toxicity(empty, toxicity.train([])).count() == 0


# --- language model -----------------------------------------------------------------------


def test_language_model(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = df.union(spark.createDataFrame([(5001, None), (5002, ""), (None, "lone words"), (5003, "the the"), (5003, "the the")], "doc_id bigint, text string"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    got = language_model.score_texts(df, F.coalesce(fold != 1, F.lit(True))).collect()
    docs = pairs(df)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    split = lambda t: words(t.translate(LOWER)) + [None]
    c = Counter(w for d, t in docs if not held(d) for w in split(t))
    total, below = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    want = sorted(
        (d or -1, len(w := split(t)), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.5) / below) for x in w), 6)) for d, t in docs
    )
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if held(r["doc_id"])) > sum(r["base_score"] for r in got if held(r["doc_id"]))


def small_vocabulary():
    return language_model.Vocabulary([(f"w{k}".encode(), 100 - k) for k in range(60)], 20, 5000, 90, {k: (10, 5) for k in range(language_model.RARE_CLASSES)})


def test_language_model_tells_frequent_words_apart():
    top = [(f"w{k}".encode(), 5000 - k) for k in range(1500)]
    v = language_model.Vocabulary(top, 20, 9_000_000, 1500, {})
    ids = v.model[:1023]
    assert len(set(ids.tolist())) == 1023 and 0 < ids.min() and ids.max() < language_model.OWN
    assert len({language_model.rare_class(f"{a}{b}".encode()) for a in "abcdefghij" for b in "klmnopqrst"}) > 16


def test_language_model_is_a_distribution():
    v = small_vocabulary()
    weights = language_model.shaped(language_model.first_weights(v))
    h = np.random.default_rng(0).uniform(-1, 1, (1, language_model.HIDDEN)).astype(np.float32)
    every = np.arange(language_model.OWN + language_model.RARE_CLASSES, dtype=np.int16)
    logs = language_model.log_probabilities(weights, np.repeat(h, len(every), 0), every)
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-4


def test_language_model_gradients():
    rng = np.random.default_rng(3)
    values = language_model.first_weights(small_vocabulary()).astype(np.float64) + rng.normal(0, 0.1, sum(int(np.prod(s)) for s in language_model.SHAPES.values()))
    tokens_ = rng.integers(0, language_model.OWN + language_model.RARE_CLASSES, (6, 3)).astype(np.int16)
    tokens_[2, 1] = 0
    before = np.concatenate([np.zeros((1, 3), np.int16), tokens_[:-1]])
    zero = np.zeros((3, language_model.HIDDEN))

    def loss(values):
        weights, h, total = language_model.shaped(values), zero, 0.0
        for t in range(6):
            h = np.where((before[t] == 0)[:, None], 0, h)
            h = language_model._step(weights["inputs"][before[t]], h, weights["recurrent"])[0]
            total -= language_model.log_probabilities(weights, h, tokens_[t]).sum()
        return total

    grad = language_model.flat(language_model.gradients(language_model.shaped(values), before, tokens_, zero)[0])
    for k in np.argsort(-np.abs(grad))[:: max(1, np.count_nonzero(grad) // 25)][:25]:
        step = np.zeros_like(values)
        step[k] = 1e-5
        assert abs((loss(values + step) - loss(values - step)) / 2e-5 - grad[k]) < 1e-3 * max(1, abs(grad[k]))


def test_language_model_carries_state():
    v = small_vocabulary()
    weights = language_model.shaped(language_model.first_weights(v))
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(1, 50, n), 0).astype(np.int16) for n in (3, 200, 0, 77, 40)]
    alone = [language_model.score_documents(weights, [d], 1, 1000)[0] for d in docs]
    assert np.allclose(language_model.score_documents(weights, docs, 2, 16), alone, rtol=1e-4)


def test_language_model_reads_many_texts_at_once():
    v = small_vocabulary()
    said = ["", "W1 w2\tnew, W59", " \x0b\x1c w3\x85a\u2003b  E\u3000 ", "   ", "xé. É a\") .\"' x!!!!!!! ab?) -\"", "new, new, w59 9z"]
    ids, sizes, place, other, kinds = v.read(pa.array(said))
    split = [t.encode().lower().split() for t in said]
    known = {f"w{k}".encode(): k for k in range(60)}
    assert sizes.tolist() == [len(own) + 1 for own in split]
    assert place.tolist() == [k for own in split for k in [*(known.get(w, -1) for w in own), 60]]
    assert other.to_pylist() == [w for own in split for w in own if w not in known]
    assert kinds.tolist() == [language_model.rare_class(w) for w in other.to_pylist()]
    rare = iter(kinds.tolist())
    assert ids.tolist() == [k for own in split for k in [*(1 + known[w] if w in known else language_model.OWN + next(rare) for w in own), 0]]
    assert v.tokens(said[1])[2] == [b"new,"]


def test_language_model_runs_of_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["a" * n for n in (3, 3, 0, 30, 1, 9, 9, 0)])], names=["doc_id", "text"])
    runs = [r.column(0).to_pylist() for r in language_model.runs_of(iter([batch.slice(0, 2), batch.slice(2, 0), batch.slice(2)]), 12)]
    assert runs == [[0, 1, 2], [3], [4, 5], [6, 7]]


# --- chats --------------------------------------------------------------------------------


def test_chat_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}],"id":7}'),
        (3, '{"prompt":"hi","response":"yo","system":"be kind"}'),
        (4, '{"instruction":"do","input":"this","output":"done"}'),
        (5, '{"instruction":"do","input":"","output":null}'),
        (6, '{"question":"q","answer":"a"}'),
        (7, '{"turn":3,"role":"user","text":null}'), (7, '{"turn":1,"role":null,"text":"x"}'),
        (8, "no json"), (9, None), (10, "[1]"), (11, '{"other":1}'),
    ]
    turns = chat_format.canonical_turns(spark.createDataFrame(records, "conv_id bigint, record string"))
    assert turns.where("role is null").select("conv_id").rdd.flatMap(list).collect().__len__() == 4
    out = {r["conv_id"]: chat_format.read_back(r["formatted"]) for r in chat_format.format_chats(turns).collect()}
    pair = [("user", "hi"), ("assistant", "yo")]
    assert out[1] == out[2] == pair and out[3] == [("system", "be kind"), *pair]
    assert out[4] == [("user", "do\n\nthis"), ("assistant", "done")] and out[5] == [("user", "do"), ("assistant", "")]
    assert out[6] == [("user", "q"), ("assistant", "a")] and out[7] == [("", "x"), ("user", "")]
    assert set(out) == set(range(1, 8))


def test_chat_round_trip():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    bits = st.sampled_from(["</s>", "<s>", "[INST]", " [/INST]", "\\", "<<SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]", "x", "\n", " ", "<", "["])
    text = st.lists(bits, max_size=8).map("".join) | st.text(max_size=20)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | text, text), max_size=5))
    def trip(turns):
        formatted, spans = chat_format.render(turns)
        assert chat_format.read_back(formatted) == turns
        assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]

    trip()


# --- everywhere ---------------------------------------------------------------------------


def test_empty_tables(empty):
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, tokens.PATTERN), RANKS).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert packing.pack(packing.cut(empty, tokens.path("word_bpe_49k.json"))).count() == 0
    assert quality_rules.judge(empty).count() == 0
    assert passage_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.link_documents(empty).count() == 0
    assert language_model.score_texts(empty, F.lit(True)).count() == 0
    vectors = empty.sparkSession.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert lattice_dedup.dedup(vectors).count() == 0
    chats = empty.sparkSession.createDataFrame([], "conv_id bigint, record string")
    assert chat_format.format_chats(chat_format.canonical_turns(chats)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    more = spark.createDataFrame(
        [(500 + k, " ".join(f"t{k}x{j}" for j in range(60)) + ".", "s", 1) for k in range(5)], "doc_id bigint, text string, source string, n_chars bigint"
    )
    whole = docs.select("doc_id", "text", "source", "n_chars").union(more).withColumn("lang", F.lit("en"))
    os.makedirs(tmp_path / "t")
    whole.write.parquet(str(tmp_path / "t" / "documents.parquet"))
    seen = whole
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path / "t"))
        assert seen.columns == whole.columns
    out = corpus_pipeline.run(spark, str(tmp_path / "t")).collect()
    kept = {r["doc_id"] for r in seen.collect()}
    assert {r["doc_id"] for r in out} == kept and set(range(500, 505)) <= kept and 7 not in kept and 3 not in kept


def test_queries_read_whole_tables(spark, sf_dir):
    from feedproj.llm.queries import QUERIES

    sha = lambda b: hashlib.sha256(b).hexdigest()
    chats = {r["conv_id"]: r for r in QUERIES["op10_chat_format"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    by[-1] = [(x, "</s>[INST] ok [/INST]") for x in ("user", "assistant")]
    assert set(chats) == set(by)
    for k, turns in by.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        assert chats[k]["turns_sha256"] == sha(said.encode()) and chats[k]["n_turns"] == len(turns)
        assert chats[k]["loss_chars"] == len(learned) and chats[k]["loss_sha256"] == sha(learned.encode())


def test_line_of_all_documents_lies_in_many_partitions(spark):
    """A line that every document holds fills several range partitions; one document keeps it."""
    rows = [(k, f"  The line that all hold\nown line number {k:05d}\nTHE LINE THAT ALL HOLD\nline of the pair {k // 2:05d}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "kept_text").collect()}
    for k, text in rows:
        lines = text.split("\n")
        want = lines if k == 0 else [lines[1]] + [lines[3]] * (k % 2 == 0)
        assert got[k] == "\n".join(want)


def test_near_copies_keep_the_same_row_in_any_order(spark):
    """One id with two texts, one of them a copy: the row that stays doesn't hang on the rows' order."""
    copy, own = " ".join(f"w{k}" for k in range(30)), " ".join(f"x{k}" for k in range(30))
    rows = [(1, copy, "a"), (5, copy, "b"), (5, own, "c"), (5, own, "d"), (7, "alone " + own, "e")]
    kept = set()
    for order in (rows, rows[::-1]):
        got = jaccard_join.filtered(spark.createDataFrame(order, "doc_id bigint, text string, source string").coalesce(1))
        kept.add(tuple(sorted(map(tuple, got.collect()))))
    assert len(kept) == 1


@pytest.mark.parametrize("counts, most", [
    ([9, 9, 9, 5, 5, 1, 1, 1, 1], 5), ([9, 9, 9, 5, 5, 1, 1, 1, 1], 4), ([7] * 9, 3), ([100, 101, 102, 103, 104], 2), ([3, 2, 1], 50)])
def test_frequent_words(spark, monkeypatch, counts, most):
    monkeypatch.setattr(language_model, "TOP_WORDS", most)
    df = spark.createDataFrame([(f"w{k}".encode(), c) for k, c in enumerate(counts)] + [(b"", 99), (b"x" * 99, 99)], "word binary, c bigint")
    got = sorted((r["c"] for r in language_model.frequent_words(df).collect()), reverse=True)
    # As many whole counts from the top as fit.
    want = [c for c in counts if sum(x >= c for x in counts) <= most]
    assert got == sorted(want, reverse=True)


def test_byte_bpe_round_trip_in_one_pass(table):
    both = byte_bpe.round_trip(table, RANKS, tokens.PATTERN).collect()
    apart = byte_bpe.decode(byte_bpe.encode(table, RANKS, tokens.PATTERN, offsets=False), RANKS).collect()
    key = lambda r: (r["doc_id"], tuple(r["ids"]), bytes(r["decoded"]))
    assert Counter(map(key, both)) == Counter(map(key, apart))
    assert all(bytes(r["decoded"]).decode() for r in both if r["ids"])
