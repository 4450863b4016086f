"""Every registered corpus query with a SQL twin gives the twin's rows."""

import duckdb
import pytest

from quern.plans import catalogue, frame_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


QUERIES, SQL = (catalogue.queries() | frame_queries.queries(), catalogue.oracle_sql() | frame_queries.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    want = rows([c[0] for c in got.description], got.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
    assert want
