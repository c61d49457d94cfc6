import random

from spanlattice.operators.periods import IntervalMap, periods_and_gaps

SCHEMA = "object_id bigint, starts array<bigint>, runs array<bigint>, entity string"


def brute(rows):
    cover = {}
    for oid, starts, runs, _ in rows:
        if oid is None:
            continue
        for s, r in zip(starts or [], runs or []):
            if s is not None and r is not None and r >= 1:
                cover.setdefault(oid, set()).update(range(s, s + r))
    out = set()
    for oid, idx in cover.items():
        edges = sorted(i for i in idx if i - 1 not in idx)
        ends = sorted(i + 1 for i in idx if i + 1 not in idx)
        out |= {(oid, "period", a, b) for a, b in zip(edges, ends)}
        out |= {(oid, "gap", a, b) for a, b in zip(ends, edges[1:])}
    return out


def rows():
    rnd = random.Random(5)
    out = [(1, None, None, "x"), (2, [], [], None), (3, [5, None, 9], [2, 3, None], "x"), (4, [5], [5, 6], "x"), (4, [10], [0], "x"), (None, [1], [1], "x"), (5, [-3, 0], [3, -2], "x"), (6, [2**62], [2**62 + 5], None)]
    out = [r for r in out if r[0] != 6] + [(7, [rnd.randrange(2000) for _ in range(40)], [rnd.randrange(-1, 30) for _ in range(40)], "x") for _ in range(6)]
    for oid in range(8, 30):
        out += [(oid, [rnd.randrange(300) for _ in range(n)], [rnd.randrange(0, 12) for _ in range(n)], "y") for n in (3, 9)]
    return out + out[:5]


def test_map_against_sets():
    rnd = random.Random(1)
    for _ in range(200):
        m, covered = IntervalMap(), set()
        for _ in range(30):
            s = rnd.randrange(80)
            e = s + rnd.randrange(1, 10)
            m.insert(s, e)
            covered |= set(range(s, e))
        assert {i for s, e in zip(m.starts, m.ends) for i in range(s, e)} == covered
        assert sorted(m.gaps.items()) == list(zip(m.ends, m.starts[1:]))


def test_periods(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = brute(rows())
    for hot in (10_000, 20, 3):  # not cut, some entities cut, all cut
        got = periods_and_gaps(df, "object_id", hot_intervals=hot, block_intervals=25).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_long_interval_over_blocks(spark):
    got = periods_and_gaps(spark.createDataFrame([(1, [0] + list(range(10, 5000, 10)) + [9000], [7000] + [3] * 499 + [1], None)], SCHEMA), "object_id", hot_intervals=10, block_intervals=40)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "gap", 7000, 9000), (1, "period", 0, 7000), (1, "period", 9000, 9001)]


def test_hot_by_repeats(spark):
    """Above the limit as delivered, below it by distinct starts: rows delivered twice, and many equal starts."""
    twice = [(1, list(range(0, 300, 10)), [4] * 29 + [50], None)] * 2
    equal = [(2, [5] * 59 + [90], list(range(1, 61)), None)]
    for rows_ in (twice, equal, twice + equal):
        got = periods_and_gaps(spark.createDataFrame(rows_, SCHEMA), "object_id", hot_intervals=40).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows_)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(df, "object_id").count() == 0
    overflow = spark.createDataFrame([(6, [2**62], [2**63 - 1], None)], SCHEMA)
    assert periods_and_gaps(overflow, "object_id").count() == 0
