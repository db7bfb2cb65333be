import duckdb
import pytest

from portcullis.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracles()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(r[columns.index(n)] for n in names) for r in cursor.fetchall())
    assert want and want == sorted(tuple(r[n] for n in names) for r in df.collect())


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
