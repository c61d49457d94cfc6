import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlattice.operators import image, metrics, watershed
from spanlattice.session import Scratch


def table(spark, array, name="v", kind="double"):
    rows = [(0, int(y), int(x), array[y, x].item()) for y, x in np.ndindex(array.shape)]
    return spark.createDataFrame(rows, f"slice int, y int, x int, {name} {kind}")


def back(df, shape, name):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


@pytest.mark.parametrize("kernel", [3, 4, 7])
def test_peaks(spark, kernel):
    rng = np.random.default_rng(kernel)
    v = rng.integers(0, 9, (14, 11)).astype(float)
    low, high = kernel // 2, kernel // 2 - (kernel % 2 == 0)
    top = np.array([[v[max(0, y - low) : y + high + 1, max(0, x - low) : x + high + 1].max() for x in range(11)] for y in range(14)])
    want = {(y, x) for y, x in np.ndindex(v.shape) if v[y, x] > 2 and v[y, x] == top[y, x]}
    df = table(spark, v)
    for dense in (True, False):
        assert {(r.y, r.x) for r in image.peaks(df, "v", 2.0, kernel, dense).collect()} == want
    some = df.filter("v > 3")  # pixels missing
    holes = np.where(v > 3, v, -1)
    top = np.array([[holes[max(0, y - low) : y + high + 1, max(0, x - low) : x + high + 1].max() for x in range(11)] for y in range(14)])
    want = {(y, x) for y, x in np.ndindex(v.shape) if holes[y, x] > 3 and holes[y, x] == top[y, x]}
    assert {(r.y, r.x) for r in image.peaks(some, "v", 3.0, kernel, False).collect()} == want


def test_boundary(spark):
    rng = np.random.default_rng(1)
    lab = np.kron(rng.integers(0, 3, (4, 4)), np.ones((4, 4), int))
    p = np.pad(lab, 1, "symmetric")
    edge = (p[:-2, 1:-1] != p[2:, 1:-1]) | (p[1:-1, :-2] != p[1:-1, 2:])
    e = np.pad(edge, 1)
    want = np.array([[e[y : y + 3, x : x + 3].any() for x in range(16)] for y in range(16)])
    assert (back(image.boundary(table(spark, lab, "label", "int"), "label"), lab.shape, "bd") == want).all()


def test_targets(spark):
    lab = np.zeros((40, 50), int)
    lab[5:15, 8:20], lab[22:33, 30:41] = 1, 2
    px = table(spark, lab, "label", "int").filter("label > 0")
    centers = image.region_centers(px, "label")
    assert {(r.y, r.x) for r in centers.collect()} == {(9, 13), (27, 35)}
    heat = back(image.heatmap(centers, 40, 50, 3.0), lab.shape, "heat")
    k = np.array(image.kernel(3.0))
    imp = np.zeros(lab.shape)
    imp[9, 13] = imp[27, 35] = 1
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "same"), 0, np.apply_along_axis(lambda v: np.convolve(v, k, "same"), 1, imp))
    assert np.allclose(heat, want / want.max()) and math.isclose(sum(k), 1)
    off = {(r.y, r.x): (r.off_y, r.off_x) for r in image.offsets(px, "label").collect()}
    assert off[(5, 8)] == (4.5, 5.5) and off[(32, 40)] == (-5.0, -5.0)
    # from targets back to instances
    points = image.offsets(px, "label").withColumn("k", F.lit(0)).withColumn("py", F.col("y") + F.col("off_y")).withColumn("px", F.col("x") + F.col("off_x"))
    found = image.peaks(table(spark, heat), "v", 0.1, 7).select(F.lit(0).alias("k"), F.when(F.col("y") < 20, 1).otherwise(2).alias("center"), F.col("y").cast("double").alias("cy"), F.col("x").cast("double").alias("cx"))
    ins = back(image.nearest_center(points, found, ["k"]), lab.shape, "center")
    assert (ins == lab).all()


def test_nearest_center_on_grid(spark):
    rnd = random.Random(3)
    centers = [(k, i, rnd.uniform(0, 60), rnd.uniform(0, 60)) for k in (0, 1) for i in range(1, 13)]
    points = [(k, i, rnd.uniform(-40, 90), rnd.uniform(-40, 90)) for k in (0, 1, 2) for i in range(60)] + [(0, 99, 5000.0, 5000.0)]
    c, p = spark.createDataFrame(centers, "k int, center int, cy double, cx double"), spark.createDataFrame(points, "k int, id int, py double, px double")
    want = {}
    for k, i, y, x in points:
        near = sorted((math.dist((y, x), (cy, cx)), j) for kk, j, cy, cx in centers if kk == k)
        want[(k, i)] = near[0][1] if near and near[0][0] < 1e4 else 0
    plain = {(r.k, r.id): r.center for r in image.nearest_center(p, c, ["k"], far=1e4).collect()}
    grid = {(r.k, r.id): r.center for r in image.nearest_center(p, c, ["k"], far=1e4, cell=6.0).collect()}
    assert plain == grid == want


def test_panoptic_merge(spark):
    rows = [(0, 0, 0, 1, 4), (0, 0, 1, 1, 4), (0, 0, 2, 2, 4), (0, 0, 3, 3, 4), (0, 1, 0, 2, 7), (0, 1, 1, 1, 7), (0, 1, 2, 3, 0), (0, 1, 3, 3, 0), (0, 2, 0, 5, 0), (0, 2, 1, 1, 0), (0, 2, 2, 1, 9)]
    got = {(r.y, r.x): r.pan for r in image.panoptic_merge(spark.createDataFrame(rows, "slice int, y int, x int, sem int, ins int"), 1000, [1, 2], 2, -1).collect()}
    assert got == {(0, 0): 1001, (0, 1): 1001, (0, 2): 1001, (0, 3): -1, (1, 0): 1002, (1, 1): 1002, (1, 2): 3000, (1, 3): 3000, (2, 0): -1, (2, 1): -1, (2, 2): 1003}


def flood_label(mask, steps):
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if not out[start]:
            n += 1
            todo = [start]
            out[start] = n
            while todo:
                c = todo.pop()
                for d in steps:
                    t = tuple(a + b for a, b in zip(c, d))
                    if all(0 <= a < s for a, s in zip(t, mask.shape)) and mask[t] and not out[t]:
                        out[t] = n
                        todo.append(t)
    return out


def test_components(spark):
    rng = np.random.default_rng(2)
    lab = rng.integers(0, 4, (15, 18))
    got = back(image.image_components(table(spark, lab, "label", "int").filter("label > 0"), "label", Scratch(spark, "t")), lab.shape, "component").astype(int)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    for k in (1, 2, 3):
        want = flood_label(lab == k, steps)
        pairs = {(a, b) for a, b in zip(want[lab == k], got[lab == k])}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    vol = rng.random((6, 7, 8)) < 0.3
    rows = [tuple(map(int, c)) for c in zip(*np.nonzero(vol))]
    df = spark.createDataFrame(rows, "z int, y int, x int")
    cube = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    for diagonal, near in ((True, cube), (False, [s for s in cube if sum(map(abs, s)) == 1])):
        want = flood_label(vol, near)
        pairs = {(want[r.z, r.y, r.x], r.component) for r in watershed.voxel_components(df, Scratch(spark, "t"), diagonal).collect()}
        assert len(pairs) == want.max() == len({b for _, b in pairs})


def test_watershed(spark):
    z, y, x = np.mgrid[:9, :20, :32]
    a, b = (z - 4) ** 2 + (y - 9) ** 2 + (x - 9) ** 2, (z - 4) ** 2 + (y - 9) ** 2 + (x - 21) ** 2
    sem = np.where((a <= 64) | (b <= 64), 250, 0)
    bd = np.where(x == 15, 250, 0)
    rows = [(*map(int, c), int(sem[c]), int(bd[c])) for c in np.ndindex(sem.shape)] + [(0, 0, 99, None, 0)]
    df = spark.createDataFrame(rows, "z int, y int, x int, sem int, bd int")
    for by_steps in (False, True):
        got = {(r.z, r.y, r.x): r.label for r in watershed.contour_watershed(df, by_steps=by_steps).collect()}
        assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(sem)))) and set(got.values()) == {1001, 1002}
        assert all(got[c] == (1001 if c[2] < 15 else 1002) for c in got if c[2] != 15)
    assert watershed.contour_watershed(df.limit(0)).count() == 0


def test_resizing(spark):
    v = np.arange(30.0).reshape(5, 6)
    up = back(image.upsample(table(spark, v), 3), (15, 18), "v")
    assert (up == np.kron(v, np.ones((3, 3)))).all()
    padded = image.pad(table(spark, v), 5, 6, 4, "v", -1)
    got = back(padded, (8, 8), "v")
    assert (got[:5, :6] == v).all() and padded.count() == 64 and (got[5:] == -1).all() and (got[:, 6:] == -1).all()
    assert image.factor_pad(5, 8, 4) == (8, 8)
    half = back(image.downsample(table(spark, v), 5, 6, 2, "v"), (3, 3), "v")
    assert half[1, 1] == pytest.approx(v[2, 2:4].mean())
    points = spark.createDataFrame([(0, 1, 0.5, 0.5), (0, 2, 0.0, 0.0)], "slice int, point int, u double, v double")
    src = table(spark, v).withColumnRenamed("v", "s")
    got = {r.point: r.s for r in image.point_sample(src, points, 5, 6, "s").collect()}
    assert got == {1: pytest.approx(v[2, 2:4].mean()), 2: pytest.approx(v[0, 0] / 4)}
    assert image.point_sample(src, points, 5, 6, "s", "nearest").filter("point = 1").first().s in (14.0, 15.0)


def test_losses(spark):
    df = spark.createDataFrame([(0, i, float(i - 3), i % 2) for i in range(10)], "k int, i int, x double, t int")
    bce = df.select("k", "i", metrics.bce(F.col("x"), F.col("t").cast("double")).alias("loss"))
    want = [math.log(1 + math.exp(-(i - 3))) if i % 2 else math.log(1 + math.exp(i - 3)) for i in range(10)]
    assert [r.loss for r in bce.orderBy("i").collect()] == pytest.approx(want)
    top = sorted(want)[-2:]
    assert metrics.hardest_mean(bce, ["k"], "loss").first().loss == pytest.approx(sum(top) / 2)
    assert metrics.hardest_mean(bce, ["k"], "loss", 1.0).first().loss == pytest.approx(sum(want) / 10)
    ce = spark.createDataFrame([([1.0, 2.0, 3.0], 1)], "l array<double>, t int").select(metrics.cross_entropy(F.col("l"), F.col("t"))).first()[0]
    assert ce == pytest.approx(-math.log(math.exp(2) / sum(map(math.exp, (1, 2, 3)))))
    assert df.withColumn("w", F.lit(0)).agg(metrics.masked_l1(["x"], ["t"], "w")).first()[0] == 0.0


def test_harden(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],), ([0.7],), ([0.4],)], "p array<double>")
    assert [r[0] for r in df.select(image.harden(F.col("p"))).collect()] == [1, 1, 0]
    assert [round(r[0], 6) for r in df.select(image.uncertainty(F.col("p"))).collect()] == [0.0, -0.7, -0.4]
    p = df.select(image.probability(F.col("p"))).collect()
    assert sum(p[0][0]) == pytest.approx(1) and p[1][0][0] == pytest.approx(1 / (1 + math.exp(-0.7)))
