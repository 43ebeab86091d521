"""Order statistics of a hot group give the same rows as of a small one, for values of any size."""

import math

import pytest

from fabgrain.functions.order_stats import quantiles

VALUES = [math.inf, -math.inf, 5e-324, 1e-323, 0.0, *(10.0**k for k in range(-300, 300, 12)), *([7.0] * 60), *(float(i) for i in range(100))]


@pytest.mark.parametrize("hot_rows", [50, 5])
def test_hot_groups_end_and_agree(spark, hot_rows):
    rows = spark.createDataFrame([("a", v) for v in VALUES] + [("b", 1.0), ("b", 3.0)], "k string, v double")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    usual = sorted(map(tuple, quantiles(rows, ["k"], "v", probs).collect()))
    assert sorted(map(tuple, quantiles(rows, ["k"], "v", probs, hot_rows=hot_rows).collect())) == usual
