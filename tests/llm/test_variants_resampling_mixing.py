"""Spelling variants, importance resampling and source mixing against plain versions of their rules."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedproj.llm import common, mixing, resampling, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- spelling variants ----------------------------------------------------------------------


def plain_words(docs, spoil):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(LOWER)
            name = "" if doc is None else doc
            h = zlib.crc32(f"{name}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_letter_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(words, ratio=10):
    cut = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[w[:k] + w[k + 1 :]].add(w)
        cut[w].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for a in group:
            near[a] |= {b for b in group if one_letter_apart(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("spoil", [None, 5])
def test_spelling_variants(table, spoil):
    got = spelling.group_variants(table, spoil=spoil)
    assert found(got) == plain_variants(plain_words(pairs(table), spoil))


def test_spelling_chains_ties_and_long_words(spark):
    counts = {"straßenx": 1000, "straßen": 95, "straßem": 9, "strassem": 2, "wordone": 50, "wordona": 50, "wordon": 9,
              "wordonx": 5, "a" * 9000: 40, "a" * 9001: 2, "b" + "a" * 9000: 3, "ÉCOLIER": 30, "écolier": 3}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "straßem")], "doc_id bigint, text string")
    want = plain_variants(plain_words([(1, text), (None, "straßem")], None))
    assert found(spelling.group_variants(docs)) == want
    assert want["straßen"][1] == "straßenx" and want["straßem"][0] is None and want["wordonx"][0] == "wordona" and want["a" * 9001][0] == "a" * 9000


@pytest.mark.parametrize("frequent, bits", [(0, 21), (3, 21), (40, 4), (10**9, 21)])
def test_two_disjoint_grams_meet_every_near_word(monkeypatch, frequent, bits):
    """Whatever the dictionary says, a word meets all its near words in the lists it looks into."""
    monkeypatch.setattr(spelling, "SLOT_BITS", bits)
    rng = np.random.default_rng(frequent % 97 + bits)
    words = set()
    for _ in range(300):
        w = "".join(rng.choice(list("abcé"), rng.integers(7, 14)))
        k = int(rng.integers(0, len(w)))
        words |= {w, w[:k] + "q" + w[k:], w[:k] + "z" + w[k + 1 :], "x" + w, w + "x"}
        if len(w) > 7:
            words.add(w[:k] + w[k + 1 :])
    words = sorted(words)
    often = np.zeros(1 << bits, np.int64)
    for _, size, hashes in spelling.tables(words):
        at = np.arange(next(iter(hashes.values())).shape[1])
        for q, h in hashes.items():
            often += np.bincount(spelling.slots_of(h[at + q <= size[:, None]]), minlength=len(often))
    often = np.where(often > frequent, np.minimum(often, 65535), 0).astype(np.uint16)
    lists, looks = defaultdict(set), defaultdict(set)
    for part, size, hashes in spelling.tables(words):
        grams = spelling.decompose(size, hashes, often)
        who, column = np.nonzero(grams["there"])
        for i, name in zip(who, spelling.list_names(grams["gram"][who, column], column % 2, column // 2, size[who]), strict=True):
            lists[int(name)].add(words[part[i]])
        left, right = spelling.two_grams(size, grams)
        rows = np.arange(len(part))
        assert grams["there"][rows, left].all() and grams["there"][rows, right].all()
        assert (grams["last"][rows, left] < grams["first"][rows, right]).all()
        for column, shift in ((left, 0), (right, 1)):
            for longer in (0, 1):
                names = spelling.list_names(grams["gram"][rows, column], column % 2, column // 2 + shift * longer, size + longer)
                for i, name in zip(part, names, strict=True):
                    looks[words[i]].add(int(name))
    met = {w: set().union(*(lists[x] for x in names)) for w, names in looks.items()}
    for a in words:
        for b in words:
            if len(a) <= len(b) and one_letter_apart(a, b):
                assert b in met[a], (a, b)


def test_spelling_empty(empty):
    assert spelling.group_variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(empty, least_chars=5)


# --- importance resampling ------------------------------------------------------------------


def plain_features(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return words + [" ".join(p) for p in zip(words, words[1:], strict=False)]


def plain_resample(docs, target, percent=25):
    counts = []
    for texts in ([t for _, t in docs], target):
        c = Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in plain_features(t))
        counts.append((c, sum(c.values())))
    (s, s_all), (t, t_all) = counts
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for doc, text in docs:
        f = plain_features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    return rows, drawn


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_resampling(spark, sf_dir, table, percent):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = resampling.resample(table, target, percent=percent).collect()
    want, drawn = plain_resample(pairs(table), [r["text"] or "" for r in target.collect()], percent)
    assert Counter(tuple(r)[:4] for r in rows) == Counter(want)
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [tuple(r)[:4] for r in ranked] == drawn
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))


def test_resampling_ties(spark):
    """Repeated rows and NULL ids are drawn one by one, with no rank missing."""
    text = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text)] * 7 + [(None, text)] * 9 + [(1, "few")], "doc_id bigint, text string").repartition(4)
    target = spark.createDataFrame([(1, "word1 word2")], "item_id bigint, text string")
    rows = resampling.resample(docs, target, percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"] is not None) == list(range(1, 9))
    assert len(rows) == 17 and all(r["rank"] is None for r in rows if r["doc_id"] == 1)


def test_resampling_long_words_and_empty(spark, docs, empty):
    said = ["x" * 200 + " é " + "ÄB" * 60 + " Z9-" + "y" * 49, "", "\x00"]
    bucket, of = resampling.features([x.encode() for x in said])
    want = Counter((k, zlib.crc32(f.encode()) % 10_000) for k, x in enumerate(said) for f in plain_features(x))
    assert Counter(zip(of.tolist(), bucket.tolist(), strict=True)) == want
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert resampling.resample(empty, target).collect() == []
    assert resampling.resample(docs, target).count() == docs.count()


@pytest.mark.parametrize("nth", [1, 2, 500, 999, 1000])
def test_least_value_counts(spark, nth):
    values = [(k * 7919) % 613 - 300 for k in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    value, below = resampling.least_value(df, "v", nth)
    assert value == sorted(values)[nth - 1] and below == sum(v < value for v in values)


# --- mixing ---------------------------------------------------------------------------------


def plain_targets(sizes, percent=150, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) * percent / 100 - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        key = np.full(n, 12345 + n)
        got = mixing.permute(np.arange(n), np.full(n, n), key)
        assert sorted(got) == list(range(n))
        assert (mixing.permute(got, np.full(n, n), key, back=True) == np.arange(n)).all()
    other = mixing.permute(np.arange(4097), np.full(4097, 4097), np.full(4097, 99))
    assert (other != got).mean() > 0.9


@pytest.mark.parametrize("block, shard", [(256, 1024), (7, 10), (100_000, 3)])
def test_mixing(table, block, shard):
    mixed = mixing.mix(table, block=block, shard=shard).cache()
    rows = mixing.taken_words(mixed).collect()
    docs = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in table.select("doc_id", "source", "text").collect()]
    sizes = Counter()
    for _, source, n in docs:
        sizes[source] += n
    want = plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows) == Counter(
        (d, n, sizes[s], round(want[s], 6)) for d, s, n in docs)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    for key in taken:
        same = [s for s in sizes if (round(want[s], 6), sizes[s]) == key]
        assert taken[key] == sum(math.floor(want[s]) for s in same)
    # Slots are filled without gaps, each by one source's consecutive words.
    slots = defaultdict(list)
    for r in mixed.where("shard is not null").collect():
        slots[r["shard"], r["position"]].append(r)
    assert all(max(p for s, p in slots if s == k) < shard for k in {s for s, _ in slots})
    for parts in slots.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at and 0 <= r["first"] and r["first"] + r["words"] <= r["size"]
            at += r["words"]
        assert at <= block
    again = mixing.taken_words(mixing.mix(table.repartition(7), block=block, shard=shard)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_mixing_draws_shards_at_random(spark):
    """A shard's mix follows the targets, and totals are exact though every shard is drawn by itself."""
    sources = spark.createDataFrame([(k, 100 * n, n, n, 100) for k, n in enumerate([500, 300, 200])], "no bigint, source_size bigint, n_blocks bigint, slots bigint, last_words bigint")
    got = mixing.draw(sources, shard=100).toPandas()
    assert got.groupby("no").size().tolist() == [500, 300, 200]
    assert sorted(zip(got.no, got.k, strict=True)) == [(k, i) for k, n in enumerate([500, 300, 200]) for i in range(n)]
    assert sorted(zip(got.shard, got.position, strict=True)) == [(s, p) for s in range(10) for p in range(100)]
    share = got[got.no == 0].groupby("shard").size()
    assert share.between(30, 70).all() and share.nunique() > 2


def test_mixing_empty_and_wordless(spark, empty):
    assert mixing.taken_words(mixing.mix(empty)).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.taken_words(mixing.mix(none)).collect()] == [(0, 0, 0.0)] * 2


# --- helpers --------------------------------------------------------------------------------


def test_aged_memory_forgets_the_older_half():
    asked = []

    def encode(keys):
        asked.extend(keys)
        return [k.encode() for k in keys]

    memory = common.Aged(limit=1000)
    for k in range(50):
        known = memory.learn({f"w{k}", "always"}, encode)
        assert known[f"w{k}"] == f"w{k}".encode() and known["always"] == b"always"
    assert asked.count("always") == 1 and len(memory.new) + len(memory.old) < 20


def test_by_bytes():
    assert list(common.by_bytes(["aa", "b", "cccc", "d"], 3)) == [["aa", "b"], ["cccc"], ["d"]]
    assert list(common.by_bytes([], 3)) == []
