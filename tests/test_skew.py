import pytest
from pyspark.sql import functions as F

from spanlattice.operators import skew


@pytest.mark.parametrize("plain", [0, 10**6])
def test_lookup(spark, monkeypatch, plain):
    monkeypatch.setattr(skew, "PLAIN_ROWS", plain)
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    rows = [(7, i) for i in range(3000)] + [(i, i) for i in range(50)] + [(None, 1), (999, 2)]
    left = spark.createDataFrame(rows, "k bigint, i bigint")
    right = spark.createDataFrame([(i, i * 10) for i in range(100)], "x bigint, value bigint")
    got = skew.lookup(left, "k", right, "x", "value", len(rows), F.xxhash64("k", "i"))
    assert got.columns == ["k", "i", "value"]
    want = sorted((str(k), i, None if k in (None, 999) else k * 10) for k, i in rows)
    assert sorted((str(r.k), r.i, r.value) for r in got.collect()) == want
