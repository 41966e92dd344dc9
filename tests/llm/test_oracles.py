"""Queries that SQL can express against their twins."""

import pytest

duckdb = pytest.importorskip("duckdb")

from ohlcraft.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df, rel = QUERIES[name](spark, data), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)
