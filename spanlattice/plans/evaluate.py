"""Scores of one tracker's documents against another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlattice.operators import metrics


def evaluate_trackers(gt: DataFrame, pred: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.75), bucket: int | tuple[int, ...] = 1 << 10) -> DataFrame:
    """metrics.evaluate by class of two tables of tracker objects, as trackers.read_json gives them: (class_id, starts, runs, label).

    Both sides must have the same classes. Arrays of unequal length count as far as both go; null elements and runs below 1 are left out.
    """
    classes = [{r[0] for r in side.select("class_id").distinct().limit(10_000).collect()} for side in (gt, pred)]  # as many as there are classes
    if classes[0] != classes[1]:
        raise ValueError(f"the classes differ: {sorted(map(str, classes[0]))} and {sorted(map(str, classes[1]))}")

    def side(objects: DataFrame, name: str) -> DataFrame:
        x = objects.select("class_id", F.col("label").cast("bigint").alias(name), F.explode(F.arrays_zip(F.col("starts").alias("s"), F.col("runs").alias("r"))).alias("x"))
        return x.filter("x.s is not null and x.r >= 1").select("class_id", name, F.col("x.s").alias("s"), (F.col("x.s") + F.col("x.r")).alias("e"))

    return metrics.evaluate(side(gt, "gt"), side(pred, "pred"), ["class_id"], thresholds, bucket)
