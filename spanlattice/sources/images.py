"""Labelled image folders <dir>/<group>/images/* and <dir>/<group>/masks/*, and their training views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlattice.operators.curate import example_weights
from spanlattice.operators.image import boundary, heatmap, offsets, region_centers
from spanlattice.sources.formats import array_of


def labelled_images(spark: SparkSession, path: str, gamma: float = 0.3) -> DataFrame:
    """(subdir, name, image, mask, weight): pairs joined on their group and file name without ending.

    Paired by name, so an image without a mask (or a mask without an image) is left out instead of shifting all others.
    """
    def side(kind: str, as_: str) -> DataFrame:
        raw = spark.read.format("binaryFile").load(f"{path}/*/{kind}/*")
        at = F.regexp_extract("path", r"([^/]+)/" + kind + r"/([^/]+?)(?:\.[^./]+)?$", 1)
        name = F.regexp_extract("path", r"([^/]+)/" + kind + r"/([^/]+?)(?:\.[^./]+)?$", 2)
        return raw.select(at.alias("subdir"), name.alias("name"), F.col("content").alias(as_))

    pairs = side("images", "image").join(side("masks", "mask"), ["subdir", "name"])
    return pairs.join(example_weights(pairs.select("subdir"), "subdir", gamma).drop("n"), "subdir")


def decoded(labelled: DataFrame, column: str, value: str = "value") -> DataFrame:
    """(subdir, name, h, w, y, x, value) of the pixels of a grey PNG or TIFF column of labelled_images, 0 included; of a stack the first page. A null file has no pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for subdir, name, data in zip(pdf["subdir"], pdf["name"], pdf[column]):
                page = array_of(data)[0]
                y, x = np.indices(page.shape, np.int32)
                yield pd.DataFrame({"subdir": subdir, "name": name, "h": np.int32(page.shape[0]), "w": np.int32(page.shape[1]), "y": y.reshape(-1), "x": x.reshape(-1), value: page.reshape(-1).astype(np.int64)})

    there = labelled.filter(F.col(column).isNotNull()).select("subdir", "name", column)
    return there.mapInPandas(run, f"subdir string, name string, h int, w int, y int, x int, `{value}` bigint")


def concat_datasets(a: DataFrame, b: DataFrame, gamma: float = 0.3) -> DataFrame:
    """Both data sets as one, with weights over all groups anew."""
    both = a.drop("weight").unionByName(b.drop("weight"))
    return both.join(example_weights(both.select("subdir"), "subdir", gamma).drop("n"), "subdir")


def panoptic_view(pixels: DataFrame, labels: list[int], things: list[int], divisor: int) -> DataFrame:
    """(slice, y, x, sem, thing): class of ids in a class's range (else 0), and the id itself for thing classes (else 0)."""
    if len(labels) < 2 or min(labels) < 1:
        raise ValueError("at least two labels, all above 0")
    c = F.floor(F.col("pan") / divisor).cast("bigint")
    return pixels.select("slice", "y", "x", F.when(c.isin(labels), c).otherwise(0).alias("sem"), F.when(c.isin(things), F.col("pan")).otherwise(0).alias("thing"))


def instance_view(pixels: DataFrame, height: int, width: int, sigma: float = 6.0) -> DataFrame:
    """(slice, y, x, sem, heat, off_y, off_x) of a class's label images: foreground, centre heat map, offsets to centroids."""
    fg = pixels.filter("label > 0")
    heat = heatmap(region_centers(fg, "label"), height, width, sigma)
    out = pixels.select("slice", "y", "x", (F.col("label") > 0).cast("int").alias("sem"))
    return out.join(heat, ["slice", "y", "x"], "left").join(offsets(fg, "label"), ["slice", "y", "x"], "left").na.fill(0.0, ["heat", "off_y", "off_x"])


def contour_view(pixels: DataFrame) -> DataFrame:
    """(slice, y, x, sem, cnt): foreground and instance contour of dense label images."""
    fg = pixels.select("slice", "y", "x", (F.col("label") > 0).cast("int").alias("sem"))
    return fg.join(boundary(pixels, "label").withColumnRenamed("bd", "cnt"), ["slice", "y", "x"])
