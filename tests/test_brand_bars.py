"""Bars per brand: the open and close of equal dates and orders, and a plan that sorts no table."""

import datetime
import random

import pytest

from ohlcraft.sources import tables as T

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"


@pytest.fixture
def lines(spark, tmp_path):
    rng, day = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = list({(rng.randrange(3), rng.randrange(4), rng.randrange(3), rng.randrange(2), rng.randrange(20)) for _ in range(400)})
    rows = [(o, p, s, n, float(rng.randrange(1, 9)), float(rng.randrange(100, 999)), day + datetime.timedelta(days=d)) for o, p, s, n, d in rows]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"B{k % 2}") for k in range(4)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path), rows


def test_open_and_close_of_equal_dates_and_orders(spark, lines):
    path, rows = lines
    groups = {}
    for o, p, s, n, q, x, at in rows:
        monday = at - datetime.timedelta(days=at.weekday())
        groups.setdefault((f"B{p % 2}", int(monday.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)), []).append(((at, o, n, p, s), x / q, q))
    want = {k: (min(g)[1], max(v for _, v, _ in g), min(v for _, v, _ in g), max(g)[1], sum(q for *_, q in g)) for k, g in groups.items()}
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in T.brand_bars(spark, path).collect()}
    assert got == want


def test_no_task_sorts_the_lines(spark, lines, monkeypatch):
    plans = []
    monkeypatch.setattr(T, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = T.brand_bars(spark, lines[0])
        plans = plans or [out._jdf.queryExecution().executedPlan().toString()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_date, of_lines = plans[0].split("SortAggregate")[-1], plans[0]
    assert "SortMergeJoin" not in of_lines
    assert "HashAggregate" in by_date and "l_shipdate" in by_date
