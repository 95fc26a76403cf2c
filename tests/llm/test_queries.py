"""The registered queries against their SQL and their contracts."""

import os
import sys

import duckdb
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

from check_oracle import TABLES, compare  # noqa: E402

from feedproj.llm.queries import ORACLES, QUERIES  # noqa: E402


def test_line_dedup_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    text, _, fine = compare(spark, con, "op4_line_dedup", QUERIES["op4_line_dedup"], ORACLES["op4_line_dedup"], sf_dir)
    assert fine, text


def test_toxicity_query(spark, sf_dir):
    out = QUERIES["op1_toxicity"](spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert out.where("predicted <> cast(score >= 0.7 as int) or score not between 0 and 1").count() == 0
    assert 0.2 < out.agg(F.avg(F.col("held_out").cast("int"))).first()[0] < 0.5


def test_registered_names():
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
