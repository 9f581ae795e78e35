"""Joins on hot keys."""

from __future__ import annotations

import pytest

from lodeatlas.plans.skew import salted_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(spark, rows, how):
    big = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 3 else None, i % 2) for i in range(300)], "id long, k string, g int")
    small = spark.createDataFrame([("hot", 1, "a"), ("k0", 0, "b"), ("k2", 0, "c"), (None, 0, "n"), ("none", 1, "d")], "k string, g int, name string")
    plain = big.alias("b").join(small.alias("s"), big["k"].eqNullSafe(small["k"]) & (big["g"] == small["g"]), how).select("b.*", *([] if how == "left_semi" else ["s.name"]))
    assert rows(salted_join(big, small, ["k", "g"], ["id"], how, hot_rows=10, salts=4)) == rows(plain)
    assert rows(salted_join(big.limit(0), small, ["k", "g"], ["id"], how)) == []
