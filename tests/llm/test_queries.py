"""The registered queries of the subpackage on the smallest tables, against SQL where there is some."""
import duckdb
import pytest

import __spark_entry__ as entry
from tests_support import same_rows
from tidewatch.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_entry_offers_the_queries():
    assert QUERIES.items() <= entry.queries().items() and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert same_rows([tuple(r[c] for c in columns) for r in df.collect()], cursor.fetchall())
