"""From predictions to slice objects, and from slice objects of three viewing directions to consensus instances of a volume."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanlattice.operators.consensus import Consensus, semantic_consensus
from spanlattice.operators.image import harden, nearest_center, panoptic_merge, peaks
from spanlattice.operators.numbering import number_rows
from spanlattice.operators.runs import cut_at_edges, encode
from spanlattice.operators.track import lift, track_backward, track_forward
from spanlattice.plans.registry import apply_filters
from spanlattice.session import Scratch
from spanlattice.streaming.median import recursive_median_array

AXES = ("xy", "xz", "yz")


def plane_shape(axis: str, shape: tuple[int, int, int]) -> tuple[int, int, int]:
    """(number of slices, rows, columns) across the axis."""
    d, h, w = shape
    return {"xy": (d, h, w), "xz": (h, d, w), "yz": (w, d, h)}[axis]


def slice_objects(pixels: DataFrame, stack: list[str], width: int, divisor: int, things: Sequence[int] = ()) -> DataFrame:
    """Objects (stack, class_id, slice, label, starts, runs) of panoptic pixels (stack, slice, y, x, pan), and of their ``class_id`` if they have one.

    Of classes in ``things``, each 8-connected part of an instance is an object of its own, as the matching of slices wants it. Their labels are
    class_id * divisor and a number from 1 in the order of the first pixels of a slice; others keep their panoptic id.
    """
    keys = [*stack, "class_id", "slice", "label"]
    own = F.col("class_id") if "class_id" in pixels.columns else F.floor(F.col("pan") / divisor).cast("int").alias("class_id")
    at = pixels.select(*stack, own, "slice", F.col("pan").cast("bigint").alias("label"), (F.col("y").cast("bigint") * width + F.col("x")).alias("i"))
    runs = encode(at, keys, "i")
    if things:
        runs = cut_at_edges(runs, keys, width, None)
    packed = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    if not things:
        return packed.select(*keys, F.transform("r", lambda x: x["s"]).alias("starts"), F.transform("r", lambda x: x["e"] - x["s"]).alias("runs"))
    whole, thing = list(things), F.col("class_id").isin(list(things))
    schema = StructType([*[packed.schema[c] for c in keys], *StructType.fromDDL("starts array<bigint>, runs array<bigint>")])
    parts = packed.mapInArrow(lambda batches: connected_parts(batches, keys, width, whole), schema)
    number = F.row_number().over(W.partitionBy(*stack, "class_id", "slice").orderBy(F.col("starts")[0], "label"))
    return parts.withColumn("label", F.when(thing, F.col("class_id").cast("bigint") * divisor + number).otherwise(F.col("label")))


def connected_parts(batches: Iterator[pa.RecordBatch], keys: list[str], width: int, things: list[int]) -> Iterator[pa.RecordBatch]:
    """(keys, starts, runs) of each 8-connected part of objects (keys, r: their runs, in order and cut at row ends); whole objects of other classes."""
    for b in batches:
        r = b.column(b.schema.get_field_index("r"))
        n = r.value_lengths().to_numpy()
        s, e = (r.flatten().field(k).to_numpy() for k in (0, 1))
        owner, y, part = np.repeat(np.arange(len(n)), n), s // width, np.zeros(len(s), np.int64)
        # a run that meets the one before it belongs to it; with only such runs an object is one part
        follows = np.zeros(len(s), bool)
        follows[1:] = (owner[1:] == owner[:-1]) & (y[1:] == y[:-1] + 1) & (s[1:] <= e[:-1] + width) & (s[:-1] + width <= e[1:])
        thing = np.isin(b.column(b.schema.get_field_index("class_id")).to_numpy(zero_copy_only=False), things)
        first = np.cumsum(n) - n
        for k in np.flatnonzero(thing & (np.bincount(owner[follows], minlength=len(n)) < n - 1)).tolist():
            i = slice(first[k], first[k] + n[k])
            part[i] = _parts(s[i].tolist(), e[i].tolist(), y[i].tolist(), width)
        order = np.lexsort((s, part, owner))
        s, e, owner, part = s[order], e[order], owner[order], part[order]
        begins = np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]
        joins = begins | np.r_[True, s[1:] != e[:-1]]  # a run that goes on in the next row is one
        at = np.flatnonzero(joins)
        s, e = s[at], e[np.r_[at[1:] - 1, len(e) - 1]]
        ends = np.r_[np.flatnonzero(begins[at]), len(at)]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (s, e - s)]
        yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)).take(pa.array(owner[begins])) for k in keys], *lists], [*keys, "starts", "runs"])


def _parts(s: list[int], e: list[int], y: list[int], width: int) -> list[int]:
    """For each run, the first run of its part; runs are in order."""
    up = list(range(len(s)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    above = 0
    for i in range(len(s)):
        while y[above] < y[i] - 1 or y[above] == y[i] - 1 and e[above] + width < s[i]:
            above += 1
        j = above
        while y[j] == y[i] - 1 and s[j] + width <= e[i]:
            a, c = find(i), find(j)
            up[max(a, c)] = min(a, c)
            j += 1
    return [find(i) for i in range(len(s))]


def segment_objects(pixels: DataFrame, stack: list[str], width: int, divisor: int, things: list[int], scratch: Scratch, median_size: int = 3, threshold: float = 0.5, nms_threshold: float = 0.1, nms_kernel: int = 7, stuff_area: int = 64, cell: float | None = None) -> DataFrame:
    """Slice objects, as slice_objects gives them, from what a model predicts: (stack, slice, y, x, sem array<double>, heat, off_y, off_x).

    Class probabilities pass the recursive median along the stack, each pixel and channel its own queue, and are hardened. Peaks of the heat are
    centres; thing pixels go to the centre nearest to where their offsets point; classes and instances are merged by slice; instances of things that are
    not connected come apart. Class 0, pixels left void, and pixels whose ``sem`` is null or empty are in no object. ``cell`` see image.nearest_center.
    """
    px = pixels.select(*stack, "slice", "y", "x", "sem", "heat", "off_y", "off_x").filter(F.size("sem") > 0)
    if median_size > 1:
        px = recursive_median_array(px, [*stack, "y", "x"], ["slice"], "sem", median_size)
    # the slice of a stack is one key from here on
    px = scratch.keep(px.select(F.struct(*stack, "slice").alias("slice"), "y", "x", harden(F.col("sem"), threshold).alias("sem"), "heat", "off_y", "off_x"))
    found = peaks(px.select("slice", "y", "x", "heat"), "heat", nms_threshold, nms_kernel, dense=False)
    number = F.row_number().over(W.partitionBy("slice").orderBy("y", "x"))
    centers = scratch.keep(found.select("slice", number.alias("center"), F.col("y").cast("double").alias("cy"), F.col("x").cast("double").alias("cx")))
    of_thing = F.col("sem").isin(things)
    points = px.filter(of_thing).select("slice", "y", "x", "sem", (F.col("y") + F.col("off_y")).alias("py"), (F.col("x") + F.col("off_x")).alias("px"))
    named = nearest_center(points, centers, ["slice"], cell=cell).select("slice", "y", "x", "sem", F.col("center").alias("ins"))
    rest = px.filter(~of_thing).select("slice", "y", "x", "sem", F.lit(0).alias("ins"))
    pan = panoptic_merge(named.unionAll(rest), divisor, things, stuff_area, 0, with_class=True).filter(F.col("class_id") > 0)
    return slice_objects(pan.select(*[F.col("slice")[c].alias(c) for c in [*stack, "slice"]], "y", "x", "class_id", "pan"), stack, width, divisor, things)


def track_axis(objects: DataFrame, axis: str, shape: tuple[int, int, int], divisor: int, scratch: Scratch, iou: float = 0.25, ioa: float = 0.25) -> DataFrame:
    """Runs (class_id, label, s, e) in the volume: forward and backward matching across one axis, then lifted."""
    n = plane_shape(axis, shape)[0]
    forward = scratch.keep(track_forward(objects, ["class_id"], divisor, iou, ioa, n))
    backward = scratch.keep(track_backward(forward, ["class_id"], divisor, iou, ioa, n))
    return scratch.keep(lift(backward, ["class_id"], axis, shape))


def boxes_of(runs: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """3D boxes of runs in a volume; a run that crosses a row's end spans all columns, and so on."""
    _, h, w = shape
    row1, row2 = F.floor(F.col("s") / w), F.floor((F.col("e") - 1) / w)
    z1, z2 = F.floor(row1 / h), F.floor(row2 / h)
    x1 = F.when(row1 == row2, F.col("s") - row1 * w).otherwise(0)
    x2 = F.when(row1 == row2, F.col("e") - row1 * w).otherwise(w)
    y1 = F.when(z1 == z2, row1 - z1 * h).otherwise(0)
    y2 = F.when(z1 == z2, row2 - z1 * h + 1).otherwise(h)
    span = [z1, y1, x1, z2 + 1, y2, x2]
    parts = runs.select(*keys, *[c.cast("int").alias(n) for c, n in zip(span, ("z1", "y1", "x1", "z2", "y2", "x2"))])
    return parts.groupBy(*keys).agg(*[(F.min if n[1] == "1" else F.max)(n).alias(n) for n in ("z1", "y1", "x1", "z2", "y2", "x2")])


def consensus_volume(by_axis: dict[str, DataFrame], shape: tuple[int, int, int], things: list[int], divisor: int, votes: int = 2, cluster_iou: float = 0.75, filters: list[dict] | None = None) -> DataFrame:
    """Runs (class_id, instance, s, e) from slice objects of each axis; thing classes by instance consensus, the others by voting."""
    spark = next(iter(by_axis.values())).sparkSession
    scratch = Scratch(spark, "orthoplane")
    tracked = [track_axis(o, axis, shape, divisor, scratch).withColumn("source", F.lit(k)) for k, (axis, o) in enumerate(by_axis.items())]
    runs = scratch.keep(reduce(DataFrame.unionByName, tracked))
    boxes = boxes_of(runs, ["source", "class_id", "label"], shape)
    objects = number_rows(boxes, ["class_id", "source", "label"], "node", scratch)
    runs = scratch.keep(runs.join(objects.select("source", "class_id", "label", "node"), ["source", "class_id", "label"]))
    objects = scratch.keep(apply_filters(scratch.keep(objects), runs, filters or []))
    runs = runs.join(objects.select("node"), "node", "left_semi")
    out = []
    for c in sorted(r[0] for r in objects.select("class_id").distinct().collect()):  # as many as there are classes
        own, r = objects.filter(F.col("class_id") == c), runs.filter(F.col("class_id") == c)
        if c in things:
            got = Consensus(own, r, len(by_axis), votes, cluster_iou).runs
        else:
            got = semantic_consensus(own, r, ["class_id"], votes)[1].select(F.lit(1).cast("bigint").alias("instance"), "s", "e")
        out.append(got.select(F.lit(c).alias("class_id"), "instance", "s", "e"))
    if not out:
        return spark.createDataFrame([], "class_id int, instance bigint, s bigint, e bigint")
    return reduce(DataFrame.unionByName, out)

