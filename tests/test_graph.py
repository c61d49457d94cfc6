import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlattice.operators import boxes, consensus, curate, graph, metrics, tiles, track, watershed
from spanlattice.operators.assign import assign, best_pairs
from spanlattice.operators.numbering import number_rows
from spanlattice.plans.orthoplane import boxes_of
from spanlattice.session import Scratch


def spans_of(index):
    at = np.sort(np.asarray(index))
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + 1).tolist())) if len(at) else []


@pytest.mark.parametrize("plain, united", [(0, 10), (10**6, 40), (10**6, 10**6)])
def test_components(spark, plain, united):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)] + [(500, 501 + i) for i in range(50)] + [(None, 3), (7, 7)]
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t"), plain, united).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            up[b] = a
    assert got == {v: find(v) for v in up}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark, "t")).count() == 0


def test_numbering(spark):
    df = spark.createDataFrame([(x, -x) for x in random.Random(2).sample(range(1000), 300)], "a bigint, b bigint")
    got = number_rows(df, ["a"], "n", Scratch(spark, "t"), 5).orderBy("n").collect()
    assert [r.n for r in got] == list(range(5, 305)) and [r.a for r in got] == sorted(r.a for r in got)


def test_assignment_comes_before_the_threshold(spark):
    pairs = [(1, 1, 1, 7 / 13), (1, 1, 2, 0.3), (1, 2, 1, 0.3), (2, 5, 5, 0.9)]
    got = assign(spark.createDataFrame(pairs, "k int, gt bigint, pred bigint, iou double"), ["k"], "gt", "pred", "iou", Scratch(spark, "t"))
    assert {(r.k, r.gt, r.pred) for r in got.collect()} == {(1, 1, 2), (1, 2, 1), (2, 5, 5)}
    assert [r.k for r in got.filter("iou >= 0.5").collect()] == [2]


def test_best_pairs():
    """Against all assignments; and the pairs alone are held, so many objects are no matter."""
    rnd = random.Random(4)
    for _ in range(200):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        w = {(i, j): rnd.choice([0, 0.3, 0.5, rnd.random()]) for i in range(n) for j in range(m) if rnd.random() < 0.7}
        got = best_pairs(w)
        assert len({a for a, _ in got}) == len(got) == len({b for _, b in got}) and all(w[x] > 0 for x in got)
        best = max(sum(w.get((i, j), 0) for i, j in enumerate(p)) for p in itertools.permutations([*range(m), *[-1] * n], n))
        assert abs(sum(w[x] for x in got) - best) < 1e-9
    assert len(best_pairs({(i, j): 1.0 + (i == j) for i in range(50_000) for j in (i, i + 1)})) == 50_000


def test_scores(spark):
    side = lambda rows, c: spark.createDataFrame(rows, f"k int, {c} bigint, s bigint, e bigint")
    gt = side([(1, 1, 0, 32), (1, 2, 100, 132), (2, 9, 0, 5)], "gt")
    pred = side([(1, 1, 0, 32), (1, 2, 100, 115), (1, 3, 200, 210), (3, 4, 0, 2)], "pred")
    got = {r.k: r for r in metrics.evaluate(gt, pred, ["k"], (0.4, 0.5)).collect()}
    assert (got[1].precision_50, got[1].recall_50, got[1].ap_50) == (pytest.approx(1 / 3), 0.5, 0.25)
    assert got[1].f1_50 == pytest.approx(0.4) and got[1].pq == pytest.approx(0.4, abs=1e-4)
    assert got[1].semantic_iou == pytest.approx(47 / 74) and got[2].semantic_iou == got[3].f1_50 == 0 and got[2].precision_50 == 1.0


# the golden volumes: balls of radius 20 in three trackers of a volume of 100 x 100 x 100

SIDE, R = 100, 20
_g = np.mgrid[-R : R + 1, -R : R + 1, -R : R + 1]
BALL = (_g**2).sum(0) <= R * R
PART = BALL.copy()
PART[:, 20:, 20:] = False


def at(shape, *corner):
    v = np.zeros((SIDE,) * 3, bool)
    v[tuple(slice(c, c + 2 * R + 1) for c in corner)] = shape
    return v


P, Q, FAR = at(BALL, 0, 0, 0), at(BALL, 15, 15, 15), at(BALL, 0, 59, 59)
HALF_Q = at(PART, 15, 15, 15)


def volume_objects(spark):
    trackers = [[P & ~Q, Q], [P, HALF_Q, FAR], [P | HALF_Q]]
    trackers[1][0] = P & ~HALF_Q  # within a tracker, what is painted later wins
    rows, runs, node = [], [], 0
    for source, masks in enumerate(trackers):
        for m in masks:
            z, y, x = np.nonzero(m)
            rows.append((node, source, 1000 + node, *(int(v) for v in (z.min(), y.min(), x.min(), z.max() + 1, y.max() + 1, x.max() + 1))))
            runs += [(node, s, e) for s, e in spans_of(np.flatnonzero(m))]
            node += 1
    o = spark.createDataFrame(rows, "node bigint, source int, label bigint, z1 int, y1 int, x1 int, z2 int, y2 int, x2 int")
    return o, spark.createDataFrame(runs, "node bigint, s bigint, e bigint"), trackers


def masks_of(runs):
    out = {}
    for r in runs.collect():
        m = out.setdefault(r.instance, np.zeros(SIDE**3, bool))
        m[r.s : r.e] = True
    return out


def test_consensus_goldens(spark):
    o, r, t = volume_objects(spark)
    split = consensus.Consensus(o, r, 3, votes=2, cluster_iou=0.75)
    painted = np.zeros(P.shape, int)
    for n, m in sorted(masks_of(split.runs).items()):
        painted[m.reshape(P.shape)] = n
    want = np.zeros(P.shape, int)
    want[P], want[HALF_Q] = 1, 2
    assert (painted == want).all() and split.boxes.count() == 2
    together = masks_of(consensus.Consensus(o, r, 3, votes=2, cluster_iou=0.5).runs)
    assert len(together) == 1 and (together[1].reshape(P.shape) == (P | HALF_Q)).all()
    one = masks_of(consensus.Consensus(o, r, 3, votes=1).runs)
    assert len(one) == 1 and (one[1].reshape(P.shape) == (P | Q)).all()
    both = masks_of(consensus.Consensus(o, r, 3, votes=1, bypass=True).runs)
    assert len(both) == 2 and (both[2].reshape(P.shape) == FAR).all() and (both[1].reshape(P.shape) == (P | Q)).all()


def test_semantic_consensus(spark):
    o, r, t = volume_objects(spark)
    from spanlattice.operators.runs import join_ranges

    one = join_ranges(r.join(o.select("node", "source"), "node"), ["source"]).selectExpr("1 as k", "s", "e")
    for votes in (1, 2, 3, 4):
        boxes_, got = consensus.semantic_consensus(o.selectExpr("1 as k", "z1", "y1", "x1", "z2", "y2", "x2"), one, ["k"], votes)
        m = np.zeros(SIDE**3, bool)
        for x in got.collect():
            m[x.s : x.e] = True
        assert (m.reshape(P.shape) == (sum(np.any(source, axis=0).astype(int) for source in t) >= votes)).all()
        assert boxes_.count() == int(m.any())


def test_settle_clusters():
    members = {1: {1, 2}, 2: {3}, 3: {4}, 4: {5, 6, 7}}
    assert consensus.settle_clusters(members, {1: {2, 3}, 2: {1}, 3: {1}}) == {1: {1, 2, 3, 4}, 4: {5, 6, 7}}
    pushed = consensus.settle_clusters(members, {1: {2, 4}, 2: {1}, 4: {1}})
    assert pushed == {2: {1, 2, 3}, 3: {4}, 4: {1, 2, 5, 6, 7}}
    chain = {1: {2}, 2: {1, 3}, 3: {2, 4}, 4: {3}}
    same = {c: {c} for c in chain}
    assert consensus.settle_clusters(same, chain) == {2: {1, 2, 3}, 4: {4}}
    assert consensus.settle_clusters(same, chain, True) == {2: {1, 2, 3, 4}}


def test_large_components_settle_as_arrays(spark, monkeypatch):
    rnd = random.Random(8)
    for _ in range(60):
        n = rnd.randrange(2, 40)
        own = {3 * c: {rnd.randrange(200) for _ in range(rnd.randrange(1, 5))} for c in range(n)}
        near = {c: set() for c in own}
        for _ in range(rnd.randrange(3 * n)):
            a, b = rnd.sample(sorted(own), 2)
            near[a].add(b)
            near[b].add(a)
        rows = np.array([(c, m) for c, ms in own.items() for m in ms])
        links = np.array([(a, b) for a in near for b in near[a] if a < b], np.int64).reshape(-1, 2)
        assert {c: set(m.tolist()) for c, m in consensus.settle_arrays(*rows.T, *links.T)} == consensus.settle_clusters(own, near)
    # a large component is never held as sets, whatever else is in its task
    rows = [(k, k + c, 1000 * k + c) for k in (0, 5000, 9000) for c in range(60 if k else 3000)]
    links = [(k, k + c, k + c + 1) for k in (0, 5000, 9000) for c in range(59 if k else 2999)]
    settle, want = consensus.settle_clusters, set()
    for k, n in ((0, 3000), (5000, 60), (9000, 60)):
        settled = settle({k + c: {1000 * k + c} for c in range(n)}, {k + c: {k + x for x in (c - 1, c + 1) if 0 <= x < n} for c in range(n)})
        want |= {(k, c, m) for c, ms in settled.items() for m in ms}

    def small(own, *rest):
        assert len(own) < 1000
        return settle(own, *rest)

    monkeypatch.setattr(consensus, "settle_clusters", small)
    got = consensus.settled_members(spark.createDataFrame(rows, "component bigint, cluster bigint, node bigint"), spark.createDataFrame(links, "component bigint, c1 bigint, c2 bigint"))
    assert {tuple(r) for r in got.coalesce(1).collect()} == want


def test_consensus_without_a_table_of_edges(spark, monkeypatch):
    """Links by a sweep, pairs as far as areas leave them open: as from all edges, over blocks, with small, large and repeated objects."""
    rnd = random.Random(12)
    objects, rows = [], []
    for n in range(400):
        where, length = rnd.randrange(60_000), rnd.choice([1, 2, 9, 60, 100, 101, 900, 15_000])
        at = (where // 7000) * 7000 + 10 if n % 5 == 0 else where
        parts = [(at, at + length), (at + length + 3, at + 2 * length + 3)][: rnd.choice([1, 2])]
        objects.append((n, rnd.randrange(4)))
        rows += [(n, s, e) for s, e in parts]
        if n % 4 == 0:  # nearly the same for another source
            objects.append((1000 + n, (objects[-1][1] + 1) % 4))
            rows += [(1000 + n, s, e + length // 9) for s, e in parts[-1:]] + [(1000 + n, s, e) for s, e in parts[:-1]]
    o, r = spark.createDataFrame(objects, "node bigint, source int"), spark.createDataFrame(rows, "node bigint, s bigint, e bigint")
    scratch = Scratch(spark, "t")
    edges = scratch.keep(graph.overlap_edges(o, r, None))
    pairs = lambda df: {tuple(x) for x in df.collect()}
    joined = lambda e: pairs(graph.with_components(o.select("node"), e, scratch).select("node", "component"))
    sized = r.join(o, "node").join(r.groupBy("node").agg(F.sum(F.col("e") - F.col("s")).alias("area")), "node")
    for block in (512, 1 << 18):
        assert joined(graph.overlap_links(sized, block)) == joined(edges)
    members = {}
    for least in (0.75, 0.3):
        similar = edges.filter(F.col("iou") > least).select("u", "v")
        assert pairs(consensus.similar_pairs(sized, least, (64, 1 << 14))) == pairs(similar) != set()
        members = scratch.keep(graph.with_components(o.select("node"), similar, scratch).select("node", F.col("component").alias("cluster")))
        rows = sized.join(members, "node").join(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster")
        want = pairs(graph.cluster_edges(members, edges, consensus.MIN_IOU, consensus.MIN_OVERLAP).select("c1", "c2"))
        assert pairs(consensus.between_clusters(rows, (64, 1 << 14))) == want and len(want) > 100
        rows = rows.join(graph.with_components(o.select("node"), edges, scratch), "node")
        assert pairs(consensus.in_rounds(rows, lambda part: consensus.between_clusters(part, 64), scratch, 150)) == want

    def never(*_):
        raise AssertionError("all edges were listed")

    whole = o.select("node", "source", *[F.lit(None).cast("int").alias(c) for c in ("z1", "z2", "y1", "y2", "x1", "x2")])
    boxed = o.join(r.groupBy("node").agg(F.min("s").alias("x1"), F.max("e").alias("x2")), "node").selectExpr("node", "source", "0 as z1", "1 as z2", "0 as y1", "1 as y2", "x1", "x2")
    for votes in (1, 2):
        want = pairs(consensus.Consensus(boxed, r, 4, votes=votes).runs)
        with monkeypatch.context() as m:
            m.setattr(consensus, "overlap_edges", never)
            got = pairs(consensus.Consensus(whole, r, 4, votes=votes, screen=False).runs)
        assert got == want != set()


def test_scratch_tables_leave_no_shuffle_files(spark):
    scratch = Scratch(spark, "t")

    def files():
        root = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        return {f for d in root for at, _, names in os.walk(d.toString()) for f in names if f.startswith("shuffle_")}

    before = files()
    kept = scratch.keep(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().repartition(3, "k"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and kept.count() == 7


def test_merged_clusters(spark):
    """Against all pairs: long overlaps, sums of short ones, shares of small clusters, across block edges."""
    rnd = random.Random(9)
    rows, at = [], {}
    for c in range(120):
        k, p = c % 3, rnd.randrange(consensus.SWEEP - 3000, consensus.SWEEP + 3000)
        at[c] = set()
        for _ in range(rnd.randrange(1, 12)):
            w = rnd.choice([1, 2, 5, 30, 101, 140, 400])
            rows.append((c, k, p, p + w))
            at[c] |= set(range(p, p + w))
            p += w + rnd.choice([1, 40, 300])
    got = {r.cluster: r.root for r in consensus.merged_clusters(spark.createDataFrame(rows, "cluster bigint, component bigint, s bigint, e bigint"), Scratch(spark, "t"), (64, 1 << 14)).collect()}
    root = {c: c for c in at}
    for a, b in itertools.combinations(at, 2):
        inter = len(at[a] & at[b])
        if a % 3 == b % 3 and (inter > 100 or inter / len(at[a] | at[b]) > 0.01) and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = {c: x if r == y else r for c, r in root.items()}
    assert got == root and 3 < len(set(root.values())) < 100


def test_tiles_round_trip_and_stitch(spark):
    """Discs seen through overlapping tiles come back as they were."""
    side, width = 200, 200
    yy, xx = np.mgrid[:side, :width]
    labels = np.zeros((side, width), int)
    for n, (cy, cx) in enumerate([(a, b) for a in range(25, side, 50) for b in range(25, width, 50)]):
        labels[(yy - cy) ** 2 + (xx - cx) ** 2 <= 400] = 1001 + n
    lay = tiles.layout(spark, side, width, (80, 90), 20)
    rows, runs, node = [], [], 0
    for t in lay.collect():
        part = labels[t.y0 : t.y1, t.x0 : t.x1]
        for lab in np.unique(part[part > 0]):
            y, x = np.nonzero(part == lab)
            rows.append((node, t.tile, 1001 + node, int(y.min()) + t.y0, int(x.min()) + t.x0, int(y.max()) + 1 + t.y0, int(x.max()) + 1 + t.x0))
            runs += [(node, t.tile, s, e) for s, e in spans_of(np.flatnonzero((part == lab).ravel()))]
            node += 1
    o = spark.createDataFrame(rows, "node bigint, source int, label bigint, y1 int, x1 int, y2 int, x2 int")
    local = spark.createDataFrame(runs, "node bigint, tile int, s bigint, e bigint")
    stitched = consensus.Stitch(o, tiles.to_image(local, lay, ["node"], width))
    got = {}
    for r in stitched.runs.collect():
        got.setdefault(r.instance, set()).update(range(r.s, r.e))
    want = {frozenset(np.flatnonzero((labels == lab).ravel()).tolist()) for lab in np.unique(labels[labels > 0])}
    assert {frozenset(x) for x in got.values()} == want and set(got) == set(range(1001, 1001 + len(want)))
    back = tiles.to_tiles(stitched.runs, lay, ["instance"], width)
    assert back.count() > 0
    region = tiles.overlap_region(spark, side, width, (80, 90), 20).collect()
    covered = np.zeros(side * width, int)
    for t in lay.collect():
        m = np.zeros((side, width), int)
        m[t.y0 : t.y1, t.x0 : t.x1] = 1
        covered += m.ravel()
    assert {i for r in region for i in range(r.s, r.e)} == set(np.flatnonzero(covered > 1).tolist())


def test_stitch_drops_lone_objects_in_overlaps(spark):
    o = spark.createDataFrame([(0, 0, 7, 0, 0, 1, 10), (1, 1, 8, 0, 5, 1, 12), (2, 1, 9, 0, 40, 1, 50), (3, 1, 9, 0, 90, 1, 99)], "node bigint, source int, label bigint, y1 int, x1 int, y2 int, x2 int")
    r = spark.createDataFrame([(0, 0, 10), (1, 5, 12), (2, 40, 50), (3, 90, 99)], "node bigint, s bigint, e bigint")
    overlap = spark.createDataFrame([(5, 10), (48, 50)], "s bigint, e bigint")
    got = consensus.Stitch(o, r, overlap)
    assert sorted(tuple(x) for x in got.runs.collect()) == [(7, 0, 12), (8, 90, 99)]


MATCH_TARGET = {1001: (0, 16, 0, 16), 1002: (30, 50, 30, 50), 1003: (0, 10, 190, 200), 1004: (150, 200, 0, 50), 1005: (170, 200, 170, 200), 1006: (100, 130, 90, 110)}
MATCH_NEXT = {1009: (0, 16, 0, 16), 1008: (30, 50, 30, 50), 1007: (0, 10, 190, 200), 1006: (150, 200, 0, 50), 1004: (180, 200, 180, 200), 1003: (100, 115, 90, 110), 1002: (115, 130, 90, 110), 1001: (50, 75, 125, 160), 1005: (170, 200, 45, 80)}
MATCHED = {1009: 1001, 1008: 1002, 1007: 1003, 1006: 1004, 1004: 1005, 1003: 1006, 1002: 1006, 1001: 1007, 1005: 1008}


def rectangle(box):
    y1, y2, x1, x2 = box
    return [(y * 200 + x1, y * 200 + x2) for y in range(y1, y2)]


def test_matcher_golden(spark):
    m = track.Matcher(1001)
    assert m.step({x: rectangle(b) for x, b in MATCH_TARGET.items()}) == {x: x for x in MATCH_TARGET}
    assert m.step({x: rectangle(b) for x, b in MATCH_NEXT.items()}) == MATCHED
    rows = [(1, z, x, [s for s, _ in rectangle(b)], [e - s for s, e in rectangle(b)]) for z, objects in enumerate((MATCH_TARGET, MATCH_NEXT)) for x, b in objects.items()]
    df = spark.createDataFrame([*rows, (1, 1, None, [1], [1]), (1, 1, 7, [None], [1]), (1, 1, 8, None, None)], "class_id int, slice int, label bigint, starts array<bigint>, runs array<bigint>")
    got = track.track_forward(df, ["class_id"], 1000)
    assert {r.label for r in got.filter("slice = 1").collect()} == {1001, 1002, 1003, 1004, 1005, 1006, 1007, 1008}
    assert got.count() == 14


@pytest.mark.parametrize("axis", ["xy", "xz", "yz"])
def test_lift_gives_the_volume_back(spark, axis):
    rng = np.random.default_rng(5)
    vol = rng.integers(0, 4, (7, 8, 9))
    rows = []
    for z in range(vol.shape["xy xz yz".split().index(axis)]):
        plane = np.take(vol, z, "xy xz yz".split().index(axis)).ravel()
        for lab in range(1, 4):
            sp = spans_of(np.flatnonzero(plane == lab))
            if sp:
                rows.append((1, z, lab, [s for s, _ in sp], [e - s for s, e in sp]))
    df = spark.createDataFrame(rows, "class_id int, slice int, label bigint, starts array<bigint>, runs array<bigint>")
    out = np.zeros(vol.size, int)
    got = track.lift(df, ["class_id"], axis, vol.shape)
    for r in got.collect():
        out[r.s : r.e] = r.label
    assert (out.reshape(vol.shape) == vol).all()
    box = {r.label: r for r in boxes_of(got, ["label"], vol.shape).collect()}
    for lab in range(1, 4):
        z, y, x = np.nonzero(vol == lab)
        assert (box[lab].z1, box[lab].y2, box[lab].x2) == (z.min(), y.max() + 1, x.max() + 1)


def test_empty_slices_break_a_track(spark):
    df = spark.createDataFrame([(1, 0, 5, [0], [9]), (1, 2, 4, [0], [9]), (1, 3, 9, [0], [9])], "class_id int, slice int, label bigint, starts array<bigint>, runs array<bigint>")
    got = {r.slice: r.label for r in track.track_forward(df, ["class_id"], 10).collect()}
    assert got == {0: 5, 2: 6, 3: 6}
    late = {r.slice: r.label for r in track.track_forward(df.filter("slice > 0"), ["class_id"], 10, length=4).collect()}
    assert late == {2: 11, 3: 11}


def test_exemplars(spark):
    rnd = random.Random(6)
    items = [(i, rnd.getrandbits(12)) for i in range(150)] + [(200, None), (None, 3)]
    classes = curate.hash_classes(spark.createDataFrame(items, "id bigint, h bigint"), "id", "h")
    reps = {r.id: r.h for r in classes.filter("id = class_id").collect()}
    pairs = curate.hash_pairs(classes, 3, 12)
    want = {(a, b) for a in reps for b in reps if a < b and bin(reps[a] ^ reps[b]).count("1") <= 3}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    kept = [r.id for r in curate.exemplars(classes.filter("id = class_id"), "id", pairs, Scratch(spark, "t")).collect()]
    assert len(kept) == len(set(kept)) and not any((a, b) in want for a in kept for b in kept)
    assert all(x in kept or any((min(x, k), max(x, k)) in want for k in kept) for x in reps)


def test_near_exemplars(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) - 2**63 for _ in range(12)]
    items = [(i, rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(63), 5)), rnd.choice(["a", "b", None])) for i in range(240)]
    classes = spark.createDataFrame(items, "id bigint, h bigint, place string")
    pairs = curate.hash_pairs(classes.withColumn("class_id", F.col("id")), 12, 64, together=2, within="place")
    want = {r.id for r in curate.exemplars(classes, "id", pairs, Scratch(spark, "t")).collect()}
    assert 12 < len(want) < 200
    for first, chunk in ((None, None), (7, 20), (40, 3)):  # one slice, or several, held against exemplars in chunks
        assert sorted(r.id for r in curate.near_exemplars(classes, 12, "place", Scratch(spark, "t"), first=first, chunk=chunk).collect()) == sorted(want)
    assert not curate.near_exemplars(classes.limit(0), 12, "place", Scratch(spark, "t")).count()


def test_scratch_tables_are_not_broadcast_by_their_packed_size(spark):
    scratch = Scratch(spark, "t")
    a, b = (scratch.keep(spark.range(1_000_000).select("id", F.lit(n).alias(c))) for n, c in ((1, "x"), (2, "y")))
    assert a.join(b, "id")._jdf.queryExecution().executedPlan().toString().count("Broadcast") == 0
    assert a.sparkSession is spark and a.join(b, "id").count() == 1_000_000


def test_watershed_broadcasts_no_voxels(spark, monkeypatch):
    plans, keep = [], Scratch.keep

    def seen(self, df):
        if {"part", "seed"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df)

    monkeypatch.setattr(Scratch, "keep", seen)
    at = lambda name: F.explode(F.sequence(F.lit(0), F.lit(3))).alias(name)
    v = spark.range(20).select("id", at("y")).select("id", "y", at("k")).select(F.lit(0).alias("z"), "y", (6 * F.col("id") + F.col("k")).cast("int").alias("x"), F.lit(250).alias("sem"), F.lit(10).alias("bd"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # some hundred bytes, as Spark estimates v
    try:
        assert watershed.contour_watershed(v, seed_size=8, min_size=12).count() == 320
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and not any("Broadcast" in p for p in plans)
