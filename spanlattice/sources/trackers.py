"""Trackers as JSON documents: one object per line with its box and its runs as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlattice.functions.rle import text_runs, text_starts, to_text

SCHEMA = "class_id int, label_divisor bigint, shape3d array<int>, axis string, finished boolean, label string, box array<int>, rle string"


def to_json_rows(objects: DataFrame, meta: DataFrame, on: list[str]) -> DataFrame:
    """Objects (label, z1..x2, starts, runs) with their tracker's columns, in the documents' form; labels become strings."""
    box = F.array(*[F.col(c).cast("int") for c in ("z1", "y1", "x1", "z2", "y2", "x2")])
    m = meta.select(*on, *[c for c in ("class_id", "label_divisor", "shape3d", "axis", "finished") if c not in on])
    return objects.join(m, on).select("class_id", "label_divisor", "shape3d", "axis", "finished", F.col("label").cast("string").alias("label"), box.alias("box"), to_text(F.col("starts"), F.col("runs")).alias("rle"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("axis").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects with label bigint, box columns, starts and runs; the axis comes from the folder."""
    raw = spark.read.schema(SCHEMA).json(path)
    box = [F.col("box")[i].alias(c) for i, c in enumerate(("z1", "y1", "x1", "z2", "y2", "x2"))]
    return raw.select("class_id", "label_divisor", "shape3d", "axis", "finished", F.col("label").cast("bigint").alias("label"), *box, text_starts(F.col("rle")).alias("starts"), text_runs(F.col("rle")).alias("runs"))
