import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("OHLCRAFT_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from ohlcraft.session import build

    session = build("tests", master="local[8]")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def bars(spark):
    """Build numbered bars from (open, high, low, close[, volume]) tuples of one or more symbols."""

    def make(series):
        if not isinstance(series, dict):
            series = {"A": series}
        rows = [
            (s, i, 1_699_833_600_000 + i * 3_600_000, *map(float, r[:4]), float(r[4]) if len(r) > 4 else 1.0)
            for s, rs in series.items()
            for i, r in enumerate(rs)
        ]
        return spark.createDataFrame(rows, "symbol string, idx long, ts long, open double, high double, low double, close double, volume double")

    return make
