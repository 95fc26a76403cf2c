"""Line dedup in Spark functions alone: keep bitmaps per document, coded as runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedproj.llm.common import SPACES, row_key, unpacked, whole_rows
from feedproj.session import checkpointed

SHORTEST_KEY = 10


def _bytes_as_chars(text: Column) -> Column:
    """Each UTF-8 byte as one character of Latin-1."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def key_hashes(key: Column) -> list[Column]:
    """128 bits of a line's key with A-Z lower-cased.

    ``lower`` would change letters beyond A-Z too. On the bytes read as Latin-1 it changes
    A-Z and the lead bytes C3-DE; two texts become equal by it only if they differ in A-Z
    alone, because a lead byte still tells its kind by the bytes that follow it.
    """
    plain = F.lower(_bytes_as_chars(key))
    return [F.xxhash64(plain), F.xxhash64(F.lit("line"), plain)]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, shortest: int = SHORTEST_KEY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key_1``, ``key_2``, ``doc_id``, ``pos``, row key: a row for each line with a long enough key."""
    rows = docs.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), *row_key(docs, key, text),
        F.posexplode(lines_of(F.col(f"`{text}`").cast("string"))).alias("pos", "line"),
    )
    stripped = rows.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.char_length("line") >= shortest)
    one, two = key_hashes(F.col("line"))
    return stripped.select(one.alias("key_1"), two.alias("key_2"), "doc_id", "pos", "row_1", "row_2")


def dropped_runs(docs: DataFrame, shortest: int = SHORTEST_KEY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_1``, ``row_2``, ``runs``: (start, size) of each run of lines that a document loses.

    Line hashes are range-partitioned by hash, document and position, so the rows of a
    frequent line lie over as many partitions as they fill. Inside a partition the rows of a
    key are sorted by document and position and streamed past its first document. Only a key
    at a partition's edge can go on in the next one: of these, one or two a partition, the
    first document of all is looked up. Texts and other columns stay behind.
    """
    laid = checkpointed(line_rows(docs, shortest, key, text))
    keys = ["key_1", "key_2"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(laid.repartitionByRange(parts, *keys, "doc_id", "pos").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"))
    edges = ends.select("low.*").union(ends.select("high.*")).distinct()
    # At most two rows for each partition.
    of_edges = ranged.join(F.broadcast(edges), keys, "left_semi").groupBy(*keys).agg(F.min("doc_id").alias("of_all"))
    stream = W.partitionBy("part", *keys).orderBy("doc_id", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = ranged.withColumn("first", F.first("doc_id").over(stream)).join(F.broadcast(of_edges), keys, "left")
    gone = met.where(F.col("doc_id") > F.least("first", "of_all")).select("row_1", "row_2", "pos").distinct()
    row = W.partitionBy("row_1", "row_2").orderBy("pos")
    runs = gone.withColumn("run", F.col("pos") - F.row_number().over(row)).groupBy("row_1", "row_2", "run").agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("size")
    )
    return runs.groupBy("row_1", "row_2").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("runs"))


def keep_mask(runs: Column, n_lines: Column) -> Column:
    """The keep bitmap: a boolean for each line."""
    end = lambda run: run["start"] + run["size"]
    before = lambda i: F.when(i > 0, end(F.get(runs, i - 1))).otherwise(0)
    cut = F.transform(runs, lambda run, i: F.concat(
        F.array_repeat(F.lit(True), run["start"] - before(i)), F.array_repeat(F.lit(False), run["size"])
    ))
    return F.concat(F.flatten(cut), F.array_repeat(F.lit(True), n_lines - end(F.element_at(runs, -1))))


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST_KEY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns), ``n_lines``, ``n_dropped``, ``runs`` and ``kept_text`` of each row.

    A line's key is the line without white space around it and with A-Z lower-cased. Keys of
    ``shortest`` code points or more that two or more documents hold lose all their lines but
    those of the smallest id. NULL and empty texts are one empty line. Rows with equal ids
    are one document, repeated rows come back repeated; rows with a NULL id take no part and
    keep their lines. A document that keeps no line has an empty text.
    """
    lines = lines_of(F.col("row").getField(text).cast("string"))
    rows = docs.select(whole_rows(docs), *row_key(docs, key, text))
    met = rows.join(dropped_runs(docs, shortest, key, text), ["row_1", "row_2"], "left")
    split = met.select("row", "runs", lines.alias("lines"))
    n = F.size("lines")
    mask = keep_mask(F.col("runs"), n)
    kept = F.array_join(F.filter("lines", lambda _, i: F.get(F.col("mask"), i)), "\n")
    return split.withColumn("mask", F.when(F.col("runs").isNotNull(), mask)).select(
        "row", n.cast("bigint").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda t, run: t + run["size"]), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("runs", F.array().cast("array<struct<start:int,size:int>>")).alias("runs"),
        F.when(F.col("runs").isNull(), F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def filtered(docs: DataFrame) -> DataFrame:
    """The documents with their kept text and its length in ``n_chars``; other columns as they were."""
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpacked(dedup_lines(docs), docs.columns, **changed)
