"""Top-k by cosine in blocks: equal to the search pair by pair, copies and odd vectors included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.plans import archive as A


def _vectors(spark, odd):
    x = np.random.default_rng(4).standard_normal((240, 6)).astype("float32")
    x[100:160] = x[7]  # a large group of copies
    x[160:170] = 2 * x[8]
    x[200] = x[201] = 0
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    if odd:
        nan, inf = float("nan"), float("inf")
        rows += [(300, None), (301, []), (350, [nan] * 6), (302, [inf, 1.0, 0.0, 0.0, 0.0, 0.0]), (303, [None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("odd", [False, True])
def test_blocks_equal_pairs(spark, monkeypatch, odd):
    monkeypatch.setattr(A, "MAX_QUERIES", 9)
    monkeypatch.setattr(A, "POINTS", 50)
    v = _vectors(spark, odd)
    q = v.filter("vec_id % 10 = 0 or vec_id > 240").select(F.col("vec_id").alias("q_id"), "embedding")
    want = A._ranked(A._pairs(v, q, 5, "embedding", "vec_id", "q_id"), 5, "vec_id", "q_id")
    cells = lambda df: sorted((r.q_id, r["rank"], r.vec_id, repr(r.score)) for r in df.collect())
    assert cells(A.cosine_top_k(v, q, 5)) == cells(want)


def test_points_meet_queries_as_matrices(spark):
    v = _vectors(spark, False)
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    plan = A.cosine_top_k(v, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_copies_beyond_a_slice_go_by_id():
    x = np.tile([[1.0, 2.0]], (9000, 1))
    x[::3] = [[2.0, 1.0]]
    row, best, score = A._best(x, np.arange(9000)[::-1].copy(), np.array([[1.0, 2.0], [0.0, 0.0]]), 3)
    assert row.tolist() == [0, 0, 0, 1, 1, 1]
    assert best.tolist() == [0, 1, 3, 0, 1, 2] and np.allclose(score, [1, 1, 1, 0, 0, 0])
