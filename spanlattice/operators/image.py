"""Pixel tables: filters, centres, grouping, panoptic merge, contours, heat maps, components, resizing.

A pixel table has the columns (slice, y, x) and values; pixels that are not there are background. Neighbourhoods are windows along one axis at a
time, per image row and then per image column, so no task holds more than a row or a column of an image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlattice.operators.graph import components
from spanlattice.operators.numbering import number_rows
from spanlattice.operators.runs import block_of
from spanlattice.session import Scratch


def class_of(pan: str, divisor: int) -> Column:
    """Class of a panoptic id."""
    return F.floor(F.col(pan) / divisor).cast("bigint")


def class_filter(pixels: DataFrame, pan: str, classes: list[int], divisor: int) -> DataFrame:
    """Pixels whose id belongs to one of the classes."""
    c = F.col(pan)
    keep = F.lit(False)
    for k in classes:
        keep = keep | ((c >= k * divisor) & (c < (k + 1) * divisor))
    return pixels.filter(keep)


def crop(pixels: DataFrame, y1: int, x1: int, y2: int, x2: int) -> DataFrame:
    """The part in a box, in the box's own coordinates."""
    inside = pixels.filter((F.col("y") >= y1) & (F.col("y") < y2) & (F.col("x") >= x1) & (F.col("x") < x2))
    return inside.withColumn("y", F.col("y") - y1).withColumn("x", F.col("x") - x1)


def region_properties(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open box, area and centroid of each region."""
    return pixels.groupBy(*keys).agg(F.min("y").alias("y1"), F.min("x").alias("x1"), (F.max("y") + 1).alias("y2"), (F.max("x") + 1).alias("x2"), F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def softmax(logits: Column) -> Column:
    """Of an array column."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def probability(logits: Column) -> Column:
    """Array of one logit: its sigmoid; of more: their softmax."""
    return F.when(F.size(logits) == 1, F.transform(logits, sigmoid)).otherwise(softmax(logits))


def harden(sem: Column, threshold: float = 0.5) -> Column:
    """Class of an array of probabilities: of one, whether it reaches the threshold; of more, the first greatest channel."""
    return F.when(F.size(sem) == 1, (sem[0] >= threshold).cast("int")).otherwise((F.array_position(sem, F.array_max(sem)) - 1).cast("int"))


def uncertainty(sem: Column) -> Column:
    """Of one logit -|x|; of more, the second greatest minus the greatest."""
    falling = F.sort_array(sem, asc=False)
    return F.when(F.size(sem) == 1, -F.abs(sem[0])).otherwise(falling[1] - falling[0])


def least_certain(pixels: DataFrame, keys: list[str], uncertain: str, n: int, tie: list[str]) -> DataFrame:
    """The ``n`` pixels of each key with the greatest value of ``uncertain`` (see uncertainty); ties by ``tie``; null values come last."""
    at = pixels.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(uncertain), *tie)))
    return at.filter(F.col("_k") <= n).drop("_k")


def training_points(pixels: DataFrame, height: int, width: int, channels: list[str], n: int, oversample: float = 3.0, important: float = 0.75, seed: int = 0) -> DataFrame:
    """(slice, point, u, v): ``n`` sampling points of each slice, in [0, 1): floor(important * n) least certain ones of n * oversample random points, and random ones.

    ``pixels``: (slice, y, x, channels), logits, of which the points take bilinear values. Points are hashes of slice and number.
    """
    if oversample < 1 or not 0 <= important <= 1:
        raise ValueError("oversample must be at least 1 and important between 0 and 1")
    chance = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed + salt).cast("bigint"), "slice", "point"), 11).cast("double") / F.lit(float(2**53))
    many, few = int(n * oversample), int(important * n)
    slices = pixels.select("slice").distinct()
    random = lambda lo, hi: slices.select("slice", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("point")).select("slice", "point", chance(0).alias("u"), chance(1).alias("v"))
    out = None
    if few:
        tried = random(0, many)
        for c in channels:
            tried = tried.join(point_sample(pixels, tried.select("slice", "point", "u", "v"), height, width, c).select("slice", "point", F.col(c)), ["slice", "point"])
        out = least_certain(tried.withColumn("_u", uncertainty(F.array(*channels))), ["slice"], "_u", few, ["point"]).select("slice", "point", "u", "v")
    if n > few:
        rest = random(many, many + n - few)
        out = rest if out is None else out.unionAll(rest)
    return out


def window_max(pixels: DataFrame, value: str, kernel: int, name: str, slice_: str = "slice") -> DataFrame:
    """Adds the greatest value in the kernel x kernel square around each pixel (an even kernel reaches one less to the right and below)."""
    low, high = -(kernel // 2), kernel // 2 - (kernel % 2 == 0)
    spread = pixels.select(slice_, F.col("y").alias("py"), F.col("x").alias("px"), F.explode(F.sequence(F.col("y") + low, F.col("y") + high)).alias("y"))
    rows = pixels.select(slice_, "y", F.col("x").alias("qx"), F.col(value).alias("_v"))
    block = max(kernel, 16)
    a = spread.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((F.col("px") + low) / block), F.floor((F.col("px") + high) / block)))))
    b = rows.withColumn("_b", F.floor(F.col("qx") / block))
    met = a.join(b, [slice_, "y", "_b"]).filter((F.col("qx") >= F.col("px") + low) & (F.col("qx") <= F.col("px") + high))
    top = met.groupBy(slice_, F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max("_v").alias(name))
    return pixels.join(top, [slice_, "y", "x"])


def dense_max(pixels: DataFrame, value: str, kernel: int, name: str, slice_: str = "slice") -> DataFrame:
    """window_max for images without missing pixels: two windows, along x and then along y."""
    low, high = -(kernel // 2), kernel // 2 - (kernel % 2 == 0)
    step = pixels.withColumn("_m", F.max(value).over(W.partitionBy(slice_, "y").orderBy("x").rangeBetween(low, high)))
    return step.withColumn(name, F.max("_m").over(W.partitionBy(slice_, "x").orderBy("y").rangeBetween(low, high))).drop("_m")


def peaks(pixels: DataFrame, value: str, threshold: float, kernel: int, dense: bool = True, slice_: str = "slice") -> DataFrame:
    """Pixels above ``threshold`` that are the greatest of their square; plateaus are kept whole."""
    top = (dense_max if dense else window_max)(pixels, value, kernel, "_top", slice_)
    return top.filter((F.col(value) > threshold) & (F.col(value) == F.col("_top")) & (F.col(value) > 0)).drop("_top")


#: Rings of cells around a point that are searched on one grid; points still open then, far from all centres, go on with cells as wide as these rings.
MAX_RING = 4


def nearest_center(points: DataFrame, centers: DataFrame, keys: list[str], py: str = "py", px: str = "px", far: float = 1e5, cell: float | None = None) -> DataFrame:
    """Adds ``center`` to each point: the nearest one of its key (ties: the least id), 0 if all are ``far`` or there is none.

    ``centers``: (keys, center, cy, cx), ids above 0. With ``cell``, centres are looked up on a grid, in rings of cells around the point until none can be nearer or ``far`` is reached, in rounds
    that hold only the points still open, with wider cells after MAX_RING rings; without it, points and centres of a key are all compared, for few centres.
    """
    if cell is not None:
        return _nearest_on_grid(points, centers, keys, py, px, far, cell)
    d = F.sqrt(F.pow(F.col("cy") - F.col(py), 2) + F.pow(F.col("cx") - F.col(px), 2))
    cols = points.columns
    near = points.withColumn("_p", F.monotonically_increasing_id()).join(centers, keys, "left").withColumn("_d", d)
    best = near.groupBy("_p", *cols).agg(F.min(F.when(F.col("_d") < far, F.struct("_d", "center"))).alias("_y"))
    return best.select(*cols, F.coalesce("_y.center", F.lit(0)).alias("center"))


def _nearest_on_grid(points: DataFrame, centers: DataFrame, keys: list[str], py: str, px: str, far: float, cell: float) -> DataFrame:
    scratch = Scratch(points.sparkSession, "nearest")
    cols = points.columns
    left = scratch.keep(points.withColumn("_p", F.monotonically_increasing_id()).withColumn("_best", F.lit(None).cast("struct<d:double,center:bigint>")))
    done, ring, first = [], 0, True
    while True:
        grid = centers.select(*keys, "center", "cy", "cx", F.floor(F.col("cy") / cell).alias("_gy"), F.floor(F.col("cx") / cell).alias("_gx"))
        steps = [(a, b) for a in range(-ring, ring + 1) for b in range(-ring, ring + 1) if first or max(abs(a), abs(b)) > ring // 2]
        cells = F.explode(F.array(*[F.struct((F.floor(F.col(py) / cell) + a).alias("y"), (F.floor(F.col(px) / cell) + b).alias("x")) for a, b in steps]))
        around = left.select("_p", *keys, py, px, cells.alias("_c")).select("_p", *keys, py, px, F.col("_c.y").alias("_gy"), F.col("_c.x").alias("_gx"))
        d = F.sqrt(F.pow(F.col("cy") - F.col(py), 2) + F.pow(F.col("cx") - F.col(px), 2))
        found = around.join(grid, [*keys, "_gy", "_gx"]).groupBy("_p").agg(F.min(F.struct(d.alias("d"), F.col("center").cast("bigint").alias("center"))).alias("_new"))
        now = scratch.keep(left.join(found, "_p", "left").withColumn("_best", F.least("_best", "_new")).drop("_new"))
        searched = ring * cell  # all centres within this are known
        sure = F.coalesce(F.col("_best.d") <= searched, F.lit(False)) | F.lit(searched >= far)
        done.append(now.filter(sure))
        left = now.filter(~sure)
        if not left.limit(1).count():
            break
        ring, first = (1 if ring == 0 else 2 * ring), False
        if ring > MAX_RING:
            cell, ring, first = cell * MAX_RING, 1, True
    out = None
    for part in done:
        part = part.select(*cols, F.when(F.col("_best.d") < far, F.col("_best.center")).otherwise(0).cast("bigint").alias("center"))
        out = part if out is None else out.unionAll(part)
    return out


def panoptic_merge(pixels: DataFrame, divisor: int, things: list[int], stuff_area: int, void: int, with_class: bool = False) -> DataFrame:
    """(slice, y, x, pan) from (slice, y, x, sem, ins); ``with_class`` adds ``class_id``, null where void, which holds also with more instances than ``divisor``.

    An instance takes the most frequent class (ties: the least) of its pixels of thing classes, and those pixels; numbers run per slice and class in the
    order of instances. Of other classes, pixels without an instance count; if they are ``stuff_area`` or more they take the class's id, else ``void``.
    """
    thing = F.col("sem").isin(things)
    votes = pixels.filter(thing & (F.col("ins") > 0)).groupBy("slice", "ins", "sem").agg(F.count(F.lit(1)).alias("n"))
    won = votes.groupBy("slice", "ins").agg(F.min(F.struct((-F.col("n")).alias("n"), "sem")).alias("x")).select("slice", "ins", F.col("x.sem").alias("cls"))
    ids = won.withColumn("k", F.row_number().over(W.partitionBy("slice", "cls").orderBy("ins"))).select("slice", "ins", "cls", (F.col("cls") * divisor + F.col("k")).alias("thing_pan"))
    stuff = pixels.filter(~thing & (F.col("ins") <= 0)).groupBy("slice", "sem").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= stuff_area).select("slice", "sem", (F.col("sem") * divisor).alias("stuff_pan"))
    out = pixels.join(ids, ["slice", "ins"], "left").join(stuff, ["slice", "sem"], "left")
    pan = F.when(thing & (F.col("ins") > 0), F.col("thing_pan")).when(~thing & (F.col("ins") <= 0), F.col("stuff_pan"))
    named = F.when(pan.isNotNull(), F.when(thing, F.col("cls")).otherwise(F.col("sem"))).cast("int").alias("class_id")
    return out.select("slice", "y", "x", F.coalesce(pan, F.lit(void)).alias("pan"), *[named] * with_class)


def boundary(pixels: DataFrame, label: str, size: int = 1) -> DataFrame:
    """Contour pixels of dense label images: a different label one step before against one step after, along y or x, then widened by ``size``.

    At the image's border the pixel itself stands for the missing neighbour.
    """
    wx, wy = W.partitionBy("slice", "y").orderBy("x"), W.partitionBy("slice", "x").orderBy("y")
    side = lambda w, k: F.coalesce(F.max(label).over(w.rangeBetween(k, k)), F.col(label))
    differs = lambda w: side(w, -1) != side(w, 1)
    edge = pixels.select("slice", "y", "x", label).withColumn("_ex", differs(wx)).withColumn("edge", (F.col("_ex") | differs(wy)).cast("int"))
    return dense_max(edge, "edge", 2 * size + 1, "bd").select("slice", "y", "x", "bd")


def kernel(sigma: float, radius: int | None = None) -> list[float]:
    """Sampled Gaussian of total 1; the radius is 4 sigma, rounded, if none is given."""
    r = round(4 * sigma) if radius is None else radius
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def heatmap(centers: DataFrame, height: int, width: int, sigma: float = 6.0, radius: int | None = None) -> DataFrame:
    """(slice, y, x, heat) near the centres (slice, y, x) of images height x width: a separable Gaussian of the impulses, scaled to a maximum of 1.

    Pixels out of all kernels' reach have no row (their heat is 0); several centres on a pixel are one impulse; images without a centre have no row.
    """
    w = kernel(sigma, radius)
    r = len(w) // 2
    near = lambda c: F.explode(F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda i: F.struct((F.col(c) + i).alias("at"), F.element_at(F.array(*map(F.lit, w)), i + r + 1).alias("w"))))
    hit = centers.select("slice", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    by_y = hit.select("slice", "x", near("y").alias("k")).groupBy("slice", "x", F.col("k.at").alias("y")).agg(F.sum("k.w").alias("v"))
    by_x = by_y.select("slice", "y", "v", near("x").alias("k")).groupBy("slice", "y", F.col("k.at").alias("x")).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"))
    inside = by_x.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    top = inside.groupBy("slice").agg(F.max("v").alias("m"))
    return inside.join(top, "slice").select("slice", "y", "x", (F.col("v") / F.col("m")).alias("heat"))


def offsets(pixels: DataFrame, label: str) -> DataFrame:
    """(slice, y, x, off_y, off_x): from each pixel of a region to the region's centroid."""
    c = region_properties(pixels, ["slice", label]).select("slice", label, "cy", "cx")
    return pixels.join(c, ["slice", label]).select("slice", "y", "x", (F.col("cy") - F.col("y")).alias("off_y"), (F.col("cx") - F.col("x")).alias("off_x"))


def region_centers(pixels: DataFrame, label: str) -> DataFrame:
    """(slice, y, x): the centroids' whole parts, where heatmap puts impulses."""
    return region_properties(pixels, ["slice", label]).select("slice", F.floor("cy").cast("int").alias("y"), F.floor("cx").cast("int").alias("x"))


def factor_pad(height: int, width: int, factor: int) -> tuple[int, int]:
    """The least height and width at or above the given ones that are multiples of ``factor``."""
    return -(-height // factor) * factor, -(-width // factor) * factor


def pad(pixels: DataFrame, height: int, width: int, factor: int, value: str, by: int | float = 0) -> DataFrame:
    """The image with rows below and columns to the right, filled with ``by``, to multiples of ``factor``."""
    h, w = factor_pad(height, width, factor)
    at = pixels.select("slice").distinct().select("slice", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")).select("slice", "y", F.explode(F.when(F.col("y") < height, F.sequence(F.lit(width), F.lit(max(w, width + 1) - 1))).otherwise(F.sequence(F.lit(0), F.lit(w - 1)))).alias("x")).filter(F.col("x") < w).filter((F.col("y") >= height) | (F.col("x") >= width))
    return pixels.select("slice", "y", "x", value).unionByName(at.select("slice", "y", "x", F.lit(by).cast(pixels.schema[value].dataType).alias(value)))


def upsample(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel repeated factor x factor times."""
    k = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    return pixels.withColumn("_a", k).withColumn("_b", k).withColumn("y", F.col("y") * factor + F.col("_a")).withColumn("x", F.col("x") * factor + F.col("_b")).drop("_a", "_b")


def downsample(pixels: DataFrame, height: int, width: int, factor: int, value: str) -> DataFrame:
    """Bilinear resizing of dense images to ceil(h / factor) x ceil(w / factor), pixel centres aligned, borders repeated."""
    h2, w2 = -(-height // factor), -(-width // factor)
    sy, sx = height / h2, width / w2
    grid = pixels.select("slice").distinct().select("slice", F.explode(F.sequence(F.lit(0), F.lit(h2 - 1))).alias("y")).select("slice", "y", F.explode(F.sequence(F.lit(0), F.lit(w2 - 1))).alias("x"))

    def near(c: str, scale: float, n: int) -> Column:
        at = (F.col(c) + 0.5) * scale - 0.5
        low = F.floor(at)
        clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
        return F.array(F.struct(clip(low).alias("at"), (F.lit(1.0) - (at - low)).alias("w")), F.struct(clip(low + 1).alias("at"), (at - low).alias("w")))

    taps = grid.withColumn("_y", F.explode(near("y", sy, height))).withColumn("_x", F.explode(near("x", sx, width)))
    src = pixels.select("slice", F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(value).cast("double").alias("_v"))
    got = taps.withColumn("_sy", F.col("_y.at")).withColumn("_sx", F.col("_x.at")).join(src, ["slice", "_sy", "_sx"])
    return got.groupBy("slice", "y", "x").agg(F.sum(F.col("_v") * F.col("_y.w") * F.col("_x.w")).alias(value))


def point_sample(pixels: DataFrame, points: DataFrame, height: int, width: int, value: str, mode: str = "bilinear") -> DataFrame:
    """Adds ``value`` to points (slice, point, u, v), u and v in [0, 1] along x and y; pixels outside the image count as 0."""
    at_x, at_y = F.col("u") * width - 0.5, F.col("v") * height - 0.5
    src = pixels.select("slice", F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(value).cast("double").alias("_v"))
    if mode == "nearest":
        got = points.withColumn("_sy", F.bround(at_y).cast("int")).withColumn("_sx", F.bround(at_x).cast("int")).join(src, ["slice", "_sy", "_sx"], "left")
        return got.select(*points.columns, F.coalesce("_v", F.lit(0.0)).alias(value))
    pair = lambda at: F.array(F.struct(F.floor(at).cast("int").alias("at"), (F.lit(1.0) - (at - F.floor(at))).alias("w")), F.struct((F.floor(at) + 1).cast("int").alias("at"), (at - F.floor(at)).alias("w")))
    taps = points.withColumn("_y", F.explode(pair(at_y))).withColumn("_x", F.explode(pair(at_x))).withColumn("_sy", F.col("_y.at")).withColumn("_sx", F.col("_x.at"))
    got = taps.join(src, ["slice", "_sy", "_sx"], "left")
    return got.groupBy(*points.columns).agg(F.sum(F.coalesce("_v", F.lit(0.0)) * F.col("_y.w") * F.col("_x.w")).alias(value))


def image_components(pixels: DataFrame, label: str, scratch: Scratch) -> DataFrame:
    """(slice, y, x, label, component): 8-connected pixels of equal label, the component being numbered from 1 by its first run.

    Works on runs of rows, and links runs of neighbouring rows that touch, corners included; only runs take part in the graph.
    """
    px = pixels.select("slice", "y", "x", label)
    k = F.col("x") - F.row_number().over(W.partitionBy("slice", "y", label).orderBy("x"))
    runs = px.withColumn("_k", k).groupBy("slice", "y", label, "_k").agg(F.min("x").alias("s"), (F.max("x") + 1).alias("e"))
    runs = scratch.keep(number_rows(runs.drop("_k"), ["slice", "y", "s"], "run", scratch))
    b = 64
    a = runs.select("slice", label, (F.col("y") + 1).alias("y"), F.col("run").alias("u"), F.col("s").alias("s1"), F.col("e").alias("e1"), F.explode(F.sequence(block_of(F.col("s") - 1, b), block_of(F.col("e"), b))).alias("_b"))
    c = runs.select("slice", label, "y", F.col("run").alias("v"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.explode(F.sequence(block_of(F.col("s"), b), block_of(F.col("e") - 1, b))).alias("_b"))
    edges = a.join(c, ["slice", label, "y", "_b"]).filter("s1 <= e2 and s2 <= e1").select("u", "v")
    got = components(edges, scratch).withColumnRenamed("v", "run")
    named = runs.join(got, "run", "left").withColumn("component", F.coalesce("component", "run"))
    return named.select("slice", label, "y", "component", F.explode(F.sequence("s", F.col("e") - 1)).alias("x")).select("slice", "y", "x", label, "component")
