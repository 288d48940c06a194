"""The registered queries that have SQL, on the smallest tables."""

import os

import duckdb
import pytest

from pagewright.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in cols]) for r in result.fetchall())
