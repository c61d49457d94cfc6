import random

from spanlattice.llm.components import groups
from spanlattice.operators import skew

SCHEMA = "edge_id bigint, node1 bigint, node2 bigint, iou double, cluster array<bigint>, node bigint, v string"


def brute(rows, threshold=0.75):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for _, a, b, w, cluster, *_ in rows:
        given = [x for x in cluster or [] if x is not None]
        for x in [a, b, *given]:
            if x is not None:
                find(x)
        links = list(zip(given, given[1:]))
        if a is not None and given:
            links.append((a, given[0]))
        if a is not None and b is not None and w is not None and threshold < w <= 1:
            links.append((a, b))
        for x, y in links:
            x, y = sorted((find(x), find(y)))
            up[y] = x
    return {(x, find(x)) for x in up}


def rows(n=400, nodes=300, seed=3):
    rnd = random.Random(seed)
    node = lambda: None if rnd.random() < 0.05 else rnd.randrange(nodes)
    weight = lambda: rnd.choice([None, float("nan"), -1.0, 0.75, 0.750001, 1.0, 1.2, rnd.random()])
    out = [(i, node(), node(), weight(), rnd.choice([None, None, [], [None], [node() for _ in range(rnd.randrange(5))]]), 1, None) for i in range(n)]
    return out + out[:20]


def test_groups(spark):
    for seed in (3, 4):
        got = groups(spark.createDataFrame(rows(seed=seed), SCHEMA), "node1", "node2", "iou", "cluster").collect()
        assert len(got) == len({r.node for r in got})
        spread = groups(spark.createDataFrame(rows(seed=seed), SCHEMA), "node1", "node2", "iou", "cluster", plain_rows=0)
        assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, got))
        spread.scratch.clear()
        assert {tuple(r) for r in got} == brute(rows(seed=seed))


def test_chain_and_hub(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    monkeypatch.setattr(skew, "PLAIN_ROWS", 0)
    from spanlattice.llm import components

    monkeypatch.setattr(components, "HOT_KEYS", 4)
    chain = [(i, i, i + 1, 0.9, None, 0, "x") for i in range(500)]
    hub = [(1000 + i, 10_000, 10_001 + i, 0.9, None, 0, "x") for i in range(3000)]
    table = chain + hub
    got = {tuple(r) for r in groups(spark.createDataFrame(table, SCHEMA), "node1", "node2", "iou", "cluster").collect()}
    assert got == brute(table)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert groups(empty, "node1", "node2", "iou", "cluster").count() == 0
    loops = spark.createDataFrame([(1, 5, 5, 0.9, [5, 5], None, None), (2, None, None, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in groups(loops, "node1", "node2", "iou", "cluster").collect()] == [(5, 5)]
