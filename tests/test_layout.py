"""Clustered tables: what a listing's filters and a slug lookup skip."""

from pyspark.sql import functions as F

from feedproj.operators import listing
from feedproj.plans.fixtures import Tables, fixture_sql
from feedproj.sources.layout import _number, interleaved, rows_scanned, write_clustered


def posts(spark):
    return spark.range(40_000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("slug-"), ((F.col("id") * 7919) % 40_000).cast("string")).alias("slug"),
        F.timestamp_seconds(1_600_000_000 + (F.col("id") * 104_729) % 10_000_000).alias("published_at"),
        F.timestamp_seconds(1_600_000_000 + (F.col("id") * 15_485_863) % 10_000_000).alias("updated_at"),
        F.lit("publish").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def test_filters_on_either_column_and_slugs_skip_files(spark, tmp_path):
    df = posts(spark)
    write_clustered(df, str(tmp_path / "z"), ["published_at", "updated_at"], {"slug": 1000}, files=64)
    table = spark.read.parquet(str(tmp_path / "z"))
    assert table.count() == 40_000
    late = "2020-12-25 00:00:00"  # about the last eighth
    for column in ("published_at", "updated_at"):
        kept = table.where(F.col(column) > F.lit(late).cast("timestamp"))
        assert sorted(r.id for r in kept.select("id").collect()) == sorted(
            r.id for r in df.where(F.col(column) > F.lit(late).cast("timestamp")).select("id").collect())
        assert rows_scanned(kept) < 40_000 / 3, column
    found = table.where(F.col("slug") == "slug-123")
    assert [r.id for r in found.collect()] == [r.id for r in df.where("slug = 'slug-123'").collect()]
    # Bloom filters leave a few files by chance.
    assert rows_scanned(found) < 40_000 / 8
    assert listing.find_by_slug(table, "slug-123").count() == 1


def test_strings_nulls_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), (None, 2), ("a", None), ("", 4)], "name string, n int")
    write_clustered(df, str(tmp_path / "a"), ["name", "n"], files=2)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "a")).collect())) == sorted(map(str, df.collect()))
    write_clustered(df.limit(0), str(tmp_path / "b"), ["name", "n"], files=2)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 0


def test_places_of_strings_are_read_from_their_bytes(spark):
    said = ["", "a", "a\0", "ab", "abcdef", "abcdefg", "abcdeg", "b", "é", "мир", "\U0001f600", None] + [f"k{k:04d}" for k in range(300)]
    df = spark.createDataFrame([(s, k * 7 % 100, None if s is None else k / 3) for k, s in enumerate(said)], "s string, n int, d double")
    z = interleaved(df, ["s", "n", "d"])
    # The number of a string is made once a row to find the borders, never to place a row.
    assert "conv(" not in df.select(z)._jdf.queryExecution().analyzed().toString()
    shares = [k / 16 for k in range(1, 16)]
    borders = df.agg(*[F.percentile_approx(_number(df, c), shares, 10_000).alias(c) for c in ("s", "n", "d")]).first()
    rows = df.select(z.alias("z"), *[_number(df, c).alias(c) for c in ("s", "n", "d")]).collect()
    for row in rows:
        want = 0
        for j, c in enumerate(("s", "n", "d")):
            place = sum(row[c] is not None and row[c] > b for b in set(borders[c]))
            want |= sum(((place >> i) & 1) << (i * 3 + j) for i in range(4))
        assert row.z == want


def test_links_are_told_apart_before_their_ids_are_hashed(spark, tmp_path):
    lines = [(k % 7 if k % 10 else None, k % 4) for k in range(200)] + [(3, 1)] * 5 + [(3, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(0, 5), (1, 5), (2, None), (3, 8), (3, 9)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    t = Tables(spark, str(tmp_path))
    got = t.fx_bridge
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    by = [x.partition("Aggregate [")[2].partition("]")[0] for x in plan.splitlines() if "Aggregate [" in x]
    assert len(by) == 1 and "l_orderkey" in by[0] and "s_nationkey" in by[0]
    whole = spark.sql(fixture_sql("spark")["fx_bridge"].replace("from lineitem", "from {l}").replace("join supplier", "join {s}"), l=t.lineitem, s=t.supplier)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert got.schema.simpleString() == whole.schema.simpleString()
