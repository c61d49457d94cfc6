import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlattice.functions import rle
from spanlattice.operators import boxes, runs

SCHEMA = "k int, s bigint, e bigint, label string"


def random_rows(seed, keys=3, n=40, span=120):
    rnd = random.Random(seed)
    rows = [(k, s, s + rnd.randrange(-2, 15), None) for k in range(keys) for s in (rnd.randrange(-20, span) for _ in range(n))]
    return rows + [(0, None, 4, "x"), (0, 3, None, "x"), (None, 5, 9, "x"), (None, 7, 12, "x"), *rows[:3]]


def cover(rows):
    out = {}
    for k, s, e, _ in rows:
        if s is not None and e is not None and s < e:
            for i in range(s, e):
                out.setdefault(k, {}).setdefault(i, 0)
                out[k][i] += 1
    return out


def ranges(points, k):
    at = sorted(points)
    starts = [i for i in at if i - 1 not in points]
    ends = [i + 1 for i in at if i + 1 not in points]
    return {(k, a, b) for a, b in zip(starts, ends)}


def rows_of(df):
    got = [tuple(r) for r in df.select("k", "s", "e").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [7, 64, 1 << 22])
def test_union_vote_invert(spark, block):
    rows = random_rows(block)
    df, c = spark.createDataFrame(rows, SCHEMA), cover(rows)
    for votes in (1, 2, 3, 9):
        want = set().union(*[ranges({i for i, n in at.items() if n >= votes}, k) for k, at in c.items()])
        assert rows_of(runs.vote_ranges(df, ["k"], votes, block)) == want
    want = set().union(*[ranges(set(range(100)) - set(at), k) for k, at in c.items()])
    assert rows_of(runs.invert(df, ["k"], 100, block)) == want


@pytest.mark.parametrize("block", [5, 1 << 22])
def test_encode_decode(spark, block):
    rnd = random.Random(4)
    points = [(k, rnd.randrange(-30, 60)) for k in (1, 2, None) for _ in range(60)] + [(1, None)]
    df = spark.createDataFrame(points, "k int, i bigint")
    want = set().union(*[ranges({i for j, i in points if j == k and i is not None}, k) for k in (1, 2, None)])
    coded = runs.encode(df, ["k"], "i", block)
    assert rows_of(coded) == want
    assert sorted(map(str, runs.decode(coded, ["k"]).collect())) == sorted(map(str, df.filter("i is not null").distinct().withColumnRenamed("i", "idx").collect()))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for got in (runs.join_ranges(df, ["k"]), runs.vote_ranges(df, ["k"], 2), runs.invert(df, ["k"], 9), runs.decode(df, ["k"]), runs.fill(df, ["s"], "k")):
        assert got.count() == 0


def test_pair_overlaps(spark):
    rnd = np.random.default_rng(3)
    sets = {n: set(rnd.choice(200, size, replace=False).tolist()) for n, size in enumerate((120, 100, 150, 5))}
    rows = [(k, s, e) for k, at in sets.items() for _, s, e in ranges(at, k)]
    df = spark.createDataFrame(rows, "a int, s bigint, e bigint")
    for bucket in (3, (1, 40), (2, 3, 64)):
        got = {(r.a, r.b): r for r in runs.pair_overlaps(df, ["a"], df.withColumnRenamed("a", "b"), ["b"], bucket=bucket).collect()}
        for a, x in sets.items():
            for b, y in sets.items():
                if x & y:
                    r = got.pop((a, b))
                    assert (r.inter, r.iou, r.ioa) == (len(x & y), pytest.approx(len(x & y) / len(x | y)), pytest.approx(len(x & y) / len(y)))
        assert not got


def test_long_and_short_ranges_meet(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rnd.integers(-500, 500, 60), rnd.choice([1, 3, 30, 900], 60)))]
    df = spark.createDataFrame(rows, "a int, s bigint, e bigint")
    got = runs.overlaps(df, ["a"], df.withColumnRenamed("a", "b"), ["b"], bucket=(1, 8, 50)).collect()
    want = {(a, b, max(s, t), min(e, f)) for a, s, e in rows for b, t, f in rows if max(s, t) < min(e, f)}
    assert len(got) == len(want) and {(r.a, r.b, r.s, r.e) for r in got} == want


def test_fill_last_wins(spark):
    df = spark.createDataFrame([(1, 0, 5, "x"), (2, 3, 8, "x"), (3, 4, 5, "x")], "order int, s bigint, e bigint, label string")
    got = {r.idx: r.order for r in runs.fill(df.withColumn("o", F.col("order")), ["o"], "order").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 2, 6: 2, 7: 2}


def test_text(spark):
    df = spark.createDataFrame([([1, 9], [2, 3]), ([], []), (None, [1])], "starts array<bigint>, runs array<bigint>")
    got = df.select(rle.to_text(F.col("starts"), F.col("runs")).alias("t"), rle.decode(F.col("starts"), F.col("runs")).alias("d")).collect()
    assert [r.t for r in got] == ["1 2 9 3", "", None] and [r.d for r in got] == [[1, 2, 9, 10, 11], [], []]
    back = spark.createDataFrame([("1 2 9 3",), ("",), (" 4 5 ",)], "t string").select(rle.text_starts(F.col("t")).alias("a"), rle.text_runs(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in back] == [([1, 9], [2, 3]), ([], []), ([4], [5])]


BOXES1 = [(1, 0, 0, 20, 40, 0, 50), (2, 10, 30, 50, 80, 20, 40), (3, 20, 10, 80, 50, 30, 50)]
BOXES2 = [(4, 5, 5, 20, 40, 5, 50), (5, 15, 35, 50, 80, 25, 40)]
BOX = "id int, y1 int, x1 int, y2 int, x2 int, z1 int, z2 int"


def test_boxes(spark):
    a, b = spark.createDataFrame([*BOXES1, (9, None, 0, 9, 9, 0, 9), (8, 5, 5, 5, 9, 0, 9)], BOX), spark.createDataFrame(BOXES2, BOX)
    assert [r[0] for r in a.filter("id < 4").orderBy("id").select(boxes.area()).collect()] == [800, 2000, 2400]
    assert [r[0] for r in a.filter("id < 4").orderBy("id").select(boxes.area(boxes.D3)).collect()] == [40000, 40000, 48000]
    flat = {(r.a_id, r.b_id): r.inter for r in boxes.overlap_join(a, b, cell=16).collect()}
    assert flat == {(1, 4): 525, (1, 5): 25, (2, 4): 100, (2, 5): 1575, (3, 5): 450}
    deep = {(r.a_id, r.b_id): r.inter for r in boxes.overlap_join(a, b, dims=boxes.D3, cell=1000).collect()}
    assert deep == {(1, 4): 23625, (1, 5): 375, (2, 4): 2000, (2, 5): 23625, (3, 5): 4500}
    merged = boxes.union_boxes(a.filter("id = 1").unionAll(b.filter("id = 5")).withColumn("k", F.lit(1)), ["k"]).first()
    assert (merged.y1, merged.x1, merged.y2, merged.x2) == (0, 0, 50, 80)
