"""Every query of the engine against its DuckDB SQL over the smallest tables."""

import duckdb
import pytest

from portcullis import registry
from portcullis.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall())
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    assert got == want


def test_all_queries_but_one_have_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"select_candidates"}
