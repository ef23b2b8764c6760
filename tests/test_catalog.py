"""Every registered query against its SQL on the smallest tables."""
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests_support import same_rows
from tidewatch.catalog.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert same_rows([tuple(r[c] for c in columns) for r in df.collect()], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert {"capture_id", "row_id", "final_score", "flag"} <= set(df.columns) and df.count() > 0
    assert not any(math.isnan(r["final_score"]) for r in df.select("final_score").collect())


def test_entry_names_every_query():
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


def test_donors_are_the_nearest_of_up_to_32(spark):
    drawn = [r["drawn"] for r in QUERIES["j14_donors"](spark, SMALL).select("drawn").collect()]
    assert 9 < max(drawn) <= 33
