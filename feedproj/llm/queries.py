"""The registered queries over the driver tables."""

from __future__ import annotations

import public_tokenizers as tokens
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedproj.llm import (
    byte_bpe,
    chat_format,
    jaccard_join,
    language_model,
    lattice_dedup,
    line_dedup,
    mixing,
    packing,
    passage_dedup,
    quality_rules,
    resampling,
    spelling,
    toxicity,
)
from feedproj.llm.common import documents
from feedproj.session import use_utc

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = lambda spark, sf_dir: run(use_utc(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def _fold(of: int) -> Column:
    """Remainder of the id's crc32."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(3) != 1)
    model = toxicity.train(toxicity.sample(docs, labels))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokens.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(documents(spark, sf_dir), ranks, tokens.PATTERN).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP4_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), keyed as (
  select doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from lines
), keys as (
  select *, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key, length(bare) >= 10 as counts from keyed
), firsts as (
  select key, min(doc_id) as first from keys where counts group by key having count(distinct doc_id) > 1
), marked as (
  select k.doc_id, k.pos, k.line, coalesce(k.counts and f.first is not null and k.doc_id > f.first, false) as gone
  from keys k left join firsts f on k.key = f.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(documents(spark, sf_dir), tokens.path("word_bpe_49k.json")))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate"
    )


#: Fixed by the contract of op10: a conversation that holds control strings.
EXTRA = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


@query("op10_chat_format")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    records = rows.select("conv_id", chat_format.turn_records(rows, "turn", "role", "text").alias("record")).union(
        spark.range(1).select(F.lit(-1).cast("bigint"), F.lit(EXTRA))
    )
    chats = chat_format.format_chats(chat_format.canonical_turns(records))
    return chats.mapInArrow(_chat_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _chat_digests(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        rows = []
        for conv, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            turns = chat_format.read_back(text)
            learned = "".join(chat_format.unescape(text[s["start"] : s["end"]]) for s in loss)
            said = "".join(f"{role}\n{x}\n" for role, x in turns)
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            rows.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha(said), "loss_chars": len(learned), "loss_sha256": sha(learned), "formatted_chars": len(text)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows)


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(documents(spark, sf_dir), size=3, percent=90)


@query("op7_lattice_dedup")
def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op9_passage_dedup")
def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passage_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("removed").cast("bigint").alias("n_removed"),
        F.aggregate("removed", F.lit(0), lambda t, s: t + s["end"] - s["start"]).cast("bigint").alias("removed_chars"),
        "removed", F.col("kept_text").alias("text"),
    )


@query("op6_language_model")
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.coalesce(_fold(5) != 1, F.lit(True))
    return language_model.score_texts(documents(spark, sf_dir), learn).select(
        "doc_id", F.coalesce(_fold(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of a string's UTF-8 bytes; ``crc_table`` must be at hand."""
    digits = f"hex(encode({text}))"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length({digits}) // 2), "
        f"lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::bigint)), "
        "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"
    )


#: crc32 of every single last byte, by the rule of its polynomial.
CRC_TABLE_SQL = """
crcs as (
  select list(list_reduce(list_prepend(v, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by v) as crc_table
  from range(256) as t(v)
)"""

OP11_SQL = rf"""
with recursive {CRC_TABLE_SQL}, runs as (
  select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents
), low as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from runs where length(run) >= 7 group by all
), hashed as (
  select run, n, {crc32_sql("doc_id::varchar || ':' || run")} as h from low, crcs
), spoiled as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n
  from hashed
), words as (
  select word, sum(n)::bigint as n from spoiled where length(word) >= 7 group by word having sum(n) >= 2
), cut as (
  select word, n, spot, substr(word, 1, spot) || substr(word, spot + 2) as rest
  from (select word, n, unnest(range(length(word)))::bigint as spot from words)
), pairs as (
  select a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.spot = b.spot and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cut a join words b on a.rest = b.word
), near as (
  select * from pairs union select other, other_n, word, n from pairs
), best as (
  select word, n, count(*) as n_near, max(other_n) as form_n, arg_min(other, (-other_n, other)) as form from near group by word, n
), forms as (
  select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near,
         case when b.form_n >= 10 * w.n then b.form end as form, case when b.form_n >= 10 * w.n then b.form_n end as form_n
  from words w left join best b on w.word = b.word
), followed as (
  select word, word as root, 0 as steps from forms
  union all select f.word, g.form, f.steps + 1 from followed f join forms g on f.root = g.word where g.form is not null
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n::bigint as form_n
from forms f join (select word, arg_max(root, steps) as root from followed group by word) r on f.word = r.word
"""


@query("op11_spelling_variants", OP11_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir), spoil=spelling.SPOIL)


def _features_sql(table: str, key: str) -> str:
    return rf"""
  select {key} as id, unnest(features) as feature from (
    select {key}, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as features
    from (select {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from {table}))"""


OP12_SQL = rf"""
with {CRC_TABLE_SQL}, found as ({_features_sql("documents", "doc_id")}
), wanted as ({_features_sql("benchmark", "item_id")}
), named as (
  select feature, {crc32_sql("feature")} % 10000 as bucket from (select feature from found union select feature from wanted), crcs
), s as (
  select bucket, count(*)::double as n from found join named using (feature) group by bucket
), t as (
  select bucket, count(*)::double as n from wanted join named using (feature) group by bucket
), totals as (
  select coalesce((select sum(n) from s), 0) as s_all, coalesce((select sum(n) from t), 0) as t_all
), gains as (
  select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + 10000) / ((coalesce(s.n, 0) + 1) * (t_all + 10000))))::bigint as gain
  from (select unnest(range(10000)) as bucket) b left join s on s.bucket = b.bucket left join t on t.bucket = b.bucket, totals
), weighed as (
  select id, count(*)::bigint as n_features, floor(sum(gain) / count(*))::bigint as weight
  from found join named using (feature) join gains using (bucket) group by id
), scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from documents left join weighed on id = doc_id
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 39
)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank
from scored left join ranked using (doc_id)
"""


@query("op12_importance_resampling", OP12_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_source_mixing")
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(documents(spark, sf_dir)))
