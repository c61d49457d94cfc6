"""Matching objects through ordered slices, forward and backward, and lifting 2D runs to 3D.

The fold over the slices of a stack is the serial part; stacks (volume, axis, class) run side by side. A task reads its stacks sorted by slice
and keeps the last slice's objects only, never a whole stack.

Slice objects: stack columns, slice int, label bigint, starts, runs array<bigint> (disjoint). Rows with a null label or without
a usable run are left out; several rows of one label in a slice are one object.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlattice.operators.assign import best_pairs
from spanlattice.operators.runs import cut_at_edges, encode, join_ranges

Spans = list[tuple[int, int]]


def merge_spans(spans: Spans) -> Spans:
    out: Spans = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def size_of(spans: Spans) -> int:
    return sum(e - s for s, e in spans)


def common_sizes(a: dict[int, Spans], b: dict[int, Spans]) -> dict[tuple[int, int], int]:
    """Sizes of the common parts of the objects of two slices that have one, by a sweep over all their spans."""
    events = sorted([(s, 0, e, x) for x, spans in a.items() for s, e in spans] + [(s, 1, e, x) for x, spans in b.items() for s, e in spans])
    out: dict[tuple[int, int], int] = {}
    open_: tuple[list, list] = ([], [])
    for s, side, e, x in events:
        other = open_[1 - side]
        other[:] = [o for o in other if o[0] > s]
        for oe, ox in other:
            pair = (x, ox) if side == 0 else (ox, x)
            out[pair] = out.get(pair, 0) + min(e, oe) - s
        open_[side].append((e, x))
    return out


class Matcher:
    """The state of one stack: the last slice's objects and the next free label."""

    def __init__(self, first_label: int, iou: float = 0.25, ioa: float = 0.25, assign_new: bool = True):
        self.iou, self.ioa, self.assign_new, self.next, self.target = iou, ioa, assign_new, first_label, None

    def step(self, objects: dict[int, Spans]) -> dict[int, int]:
        """New label of each object of the next slice (labels in ascending order matter for new ones).

        By the best one-to-one assignment if its IoU reaches ``iou``; else the target with the greatest share of the object, if that
        share reaches ``ioa`` (ties: the least label); else a new label, or its own without ``assign_new``.
        """
        objects = dict(sorted(objects.items()))
        if self.target is None:
            named = {x: x for x in objects}
            self.next = max(objects) + 1 if objects else self.next
        else:
            named = self._match(objects)
        after: dict[int, Spans] = {}
        for x, spans in objects.items():
            after.setdefault(named[x], []).extend(spans)
        self.target = {x: merge_spans(spans) for x, spans in sorted(after.items())}
        return named

    def _match(self, objects: dict[int, Spans]) -> dict[int, int]:
        inter = common_sizes(self.target, objects)
        size = {t: size_of(self.target[t]) for t in {t for t, _ in inter}}, {m: size_of(objects[m]) for m in {m for _, m in inter}}
        iou: dict[tuple[int, int], float] = {}
        share: dict[int, tuple[float, int]] = {}
        for (t, m), n in inter.items():
            iou[t, m] = n / (size[0][t] + size[1][m] - n)
            share[m] = max(share.get(m, (0.0, 0)), (n / size[1][m], -t))
        matched = {m: t for t, m in best_pairs(iou) if iou[t, m] >= self.iou}
        out = {}
        for x in objects:
            if x in matched:
                out[x] = matched[x]
            elif share.get(x, (0.0, 0))[0] >= self.ioa and x in share:
                out[x] = -share[x][1]
            elif self.assign_new:
                out[x] = self.next
                self.next += 1
            else:
                out[x] = x
        return out


def _spans_of(starts, runs) -> Spans:
    return [(int(s), int(s) + int(r)) for s, r in zip(starts, runs)]


def fold_slices(objects: DataFrame, stack: list[str], descending: bool, first_label, iou: float, ioa: float, assign_new: bool, length: int | None = None) -> DataFrame:
    """(stack, slice, label, new_label) of all objects, folded slice by slice.

    A slice without objects leaves nothing to match with. With the stack's ``length``, so do slices without objects
    before the first one that has any; else that one starts the stack.
    """
    cols = [*stack, "slice", "label", "starts", "runs"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = at = matcher = None
        waiting: dict[int, Spans] = {}
        done: list = []

        def close() -> None:
            if waiting:
                done.extend((*key, at, x, y) for x, y in matcher.step(waiting).items())
                waiting.clear()

        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                now, z = row[: len(stack)], row[len(stack)]
                if now != key or z != at:
                    close()
                    if now != key:
                        key, matcher = now, Matcher(first_label(dict(zip(stack, now))), iou, ioa, assign_new)
                        at = None if length is None else length if descending else -1
                    if at is not None and abs(z - at) > 1:
                        matcher.target = {}
                    at = z
                waiting.setdefault(row[-3], []).extend(_spans_of(row[-2], row[-1]))
            if done:
                yield pd.DataFrame(done, columns=[*stack, "slice", "label", "new_label"])
                done.clear()
        close()
        if done:
            yield pd.DataFrame(done, columns=[*stack, "slice", "label", "new_label"])

    order = [*stack, F.desc("slice") if descending else F.col("slice"), "label"]
    schema = ", ".join(f"`{c}` {objects.schema[c].dataType.simpleString()}" for c in [*stack, "slice", "label"]) + ", new_label bigint"
    return objects.select(*cols).repartition(*stack).sortWithinPartitions(*order).mapInPandas(fold, schema)


def usable_objects(objects: DataFrame, stack: list[str]) -> DataFrame:
    good = F.filter(F.arrays_zip(F.col("starts").alias("s"), F.col("runs").alias("r")), lambda x: x["s"].isNotNull() & (x["r"] >= 1))
    out = objects.filter("label is not null and slice is not null").withColumn("_g", good).filter(F.size("_g") > 0)
    return out.select(*stack, "slice", F.col("label").cast("bigint").alias("label"), F.transform("_g", lambda x: x["s"]).alias("starts"), F.transform("_g", lambda x: x["r"]).alias("runs"))


def _renamed(objects: DataFrame, names: DataFrame, stack: list[str]) -> DataFrame:
    out = objects.join(names, [*stack, "slice", "label"]).select(*stack, "slice", F.col("new_label").alias("label"), F.explode(F.arrays_zip("starts", "runs")).alias("x"))
    spans = join_ranges(out.select(*stack, "slice", "label", F.col("x.starts").alias("s"), (F.col("x.starts") + F.col("x.runs")).alias("e")), [*stack, "slice", "label"])
    packed = spans.groupBy(*stack, "slice", "label").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    return packed.select(*stack, "slice", "label", F.transform("r", lambda x: x["s"]).alias("starts"), F.transform("r", lambda x: x["e"] - x["s"]).alias("runs"))


def _first_label(label_divisor: int):
    return lambda key: int(key["class_id"]) * label_divisor + 1


def track_forward(objects: DataFrame, stack: list[str], label_divisor: int, iou: float = 0.25, ioa: float = 0.25, length: int | None = None) -> DataFrame:
    """Slice objects under labels that hold through the stack; objects that come to one label in a slice are merged. ``stack`` has class_id."""
    objects = usable_objects(objects, stack)
    return _renamed(objects, fold_slices(objects, stack, False, _first_label(label_divisor), iou, ioa, True, length), stack)


def track_backward(objects: DataFrame, stack: list[str], label_divisor: int, iou: float = 0.25, ioa: float = 0.25, length: int | None = None) -> DataFrame:
    """The pass from the last slice to the first, which gives no new labels."""
    objects = usable_objects(objects, stack)
    return _renamed(objects, fold_slices(objects, stack, True, _first_label(label_divisor), iou, ioa, False, length), stack)


def lift(objects: DataFrame, stack: list[str], axis: str, shape: tuple[int, int, int]) -> DataFrame:
    """(stack, label, s, e) in the volume of ``shape`` (d, h, w), from slice objects across ``axis`` 'xy', 'xz' or 'yz'.

    Runs that cross a row's end in the plane are cut there first. Slices across x have no runs along x: their indices are encoded anew.
    """
    d, h, w = shape
    keys = [*stack, "slice", "label"]
    runs = objects.select(*keys, F.explode(F.arrays_zip("starts", "runs")).alias("x")).select(*keys, F.col("x.starts").alias("s"), (F.col("x.starts") + F.col("x.runs")).alias("e"))
    z = F.col("slice").cast("bigint")
    out = [*stack, "label"]
    if axis == "xy":
        return join_ranges(runs.select(*out, (F.col("s") + z * (h * w)).alias("s"), (F.col("e") + z * (h * w)).alias("e")), out)
    if axis == "xz":  # the plane's index is z * w + x, and the slice is y
        rows = cut_at_edges(runs, keys, w, "z")
        at = F.col("z") * (h * w) + z * w - F.col("z") * w
        return join_ranges(rows.select(*out, (F.col("s") + at).alias("s"), (F.col("e") + at).alias("e")), out)
    if axis == "yz":  # the plane's index is z * h + y, and the slice is x
        return encode(runs.select(*out, F.explode(F.sequence("s", F.col("e") - 1)).alias("i"), z.alias("x")).select(*out, (F.col("i") * w + F.col("x")).alias("i")), out, "i")
    raise ValueError(f"axis {axis!r} is none of 'xy', 'xz', 'yz'")


def lift_boxes(objects: DataFrame, stack: list[str], axis: str) -> DataFrame:
    """3D boxes (stack, label, z1..x2) from slice objects with 2D boxes y1, x1, y2, x2: the slice is [i, i + 1) on the axis; least box around all."""
    i, j = F.col("slice"), F.col("slice") + 1
    a = {"y1": F.col("y1"), "x1": F.col("x1"), "y2": F.col("y2"), "x2": F.col("x2")}
    by_axis = {
        "xy": (i, a["y1"], a["x1"], j, a["y2"], a["x2"]),
        "xz": (a["y1"], i, a["x1"], a["y2"], j, a["x2"]),
        "yz": (a["y1"], a["x1"], i, a["y2"], a["x2"], j),
    }
    names = ["z1", "y1", "x1", "z2", "y2", "x2"]
    boxes = objects.select(*stack, "label", *[c.alias(n) for c, n in zip(by_axis[axis], names)])
    return boxes.groupBy(*stack, "label").agg(*[(F.min if n[1] == "1" else F.max)(n).alias(n) for n in names])
