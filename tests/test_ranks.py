"""Order statistics against Spark's own percentile, which holds all values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import ranks as R

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns(spark, n=20_000):
    rng = np.random.default_rng(2)
    wide = rng.normal(size=n) * 10.0 ** rng.integers(-12, 12, n)
    rows = [(float(a), float(b), 7.5, float(c), None) for a, b, c in zip(wide, rng.integers(0, 3, n), rng.normal(size=n))]
    rows += [(None, 1.0, 7.5, float("-inf"), None), (None, 2.0, None, float("inf"), None), (1e300, -0.0, 7.5, 5e-324, None)]
    return spark.createDataFrame(rows, "wide double, few double, same double, plain double, none double").repartition(4)


@pytest.mark.parametrize("small", [1, 100, 1_000_000])
def test_equals_percentile(spark, small):
    df = columns(spark).cache()
    got = R.order_statistics(df, {c: SHARES for c in df.columns}, small)
    for c in df.columns:
        want = df.agg(*[F.percentile(c, p) for p in SHARES]).first()
        assert got[c] == list(want), c


def test_what_reaches_the_driver_is_small(spark, monkeypatch):
    sizes = []
    df = columns(spark)
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    R.order_statistics(df, {c: [0.5] for c in df.columns}, 50)
    assert max(sizes) <= (R.CUTS + 2) * len(df.columns)


def test_nan_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (float("nan"), 1), (2.0, None)], "a double, b int")
    got = R.order_statistics(df, {"a": [0.0, 0.5, 1.0], "b": [0.5]})
    assert got["a"][:2] == [1.0, 2.0] and math.isnan(got["a"][2]) and got["b"] == [2.0]
    assert R.order_statistics(df.where("false"), {"a": [0.5]}) == {"a": [None]}
