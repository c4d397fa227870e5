"""Queries that SQL can state, against DuckDB."""

import duckdb
import pytest

from quarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.execute(queries.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())


def test_names():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
