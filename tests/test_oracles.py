"""Every registered query against its SQL on the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

from feedproj.plans.registry import ORACLES, QUERIES  # noqa: E402

# The whole-batch queries share one plan; one of them is enough here.
SLOW = {"apply_batch_posts", "apply_batch_versions", "apply_batch_bridge", "apply_batch_ledger", "write_projection"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, sf_dir, name):
    text, _, fine = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert fine, text


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == entry.entry(spark).columns and df.count() > 0
