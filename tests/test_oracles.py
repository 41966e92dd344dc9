"""Queries against their SQL twins; ``OHLCRAFT_ALL=1`` runs every one of them."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from ohlcraft.queries import load  # noqa: E402

QUERIES, ORACLES = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["average_cross_report", "bars_brands", "resample_1w", "asof_higher_timeframe", "ema", "rsi", "adx", "avsl", "ott", "supertrend",
         "cdl_all_counts", "barrier_outcome", "reverse_exit", "accrual_stream", "nw_sharpe", "max_drawdown", "zigzag_pivots",
         "entry_candidates", "block_features", "conditions", "top_bottom_book", "text_chunks", "stream_ema", "spearman_streams", "block_distances", "factor_spectrum", "factor_residual_book", "two_sided_carry", "nested_folds", "poisson_bootstrap"]
NAMES = sorted(ORACLES) if os.environ.get("OHLCRAFT_ALL") else QUICK


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def cells(rows):
    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rel = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = cells([tuple(r[c] for c in cols) for r in df.collect()])
    at = [rel.columns.index(c) for c in cols]
    assert got == cells([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_every_query_has_a_stable_schema():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 250
