"""Operators by name: filters of objects, metrics, models, augmentations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlattice.operators import metrics
from spanlattice.operators.image import crop, upsample
from spanlattice.operators.runs import areas

FILTERS: dict[str, Callable[..., DataFrame]] = {}
MODELS: dict[str, Callable] = {}
METRICS: dict[str, Callable] = {}
AUGMENTATIONS: dict[str, Callable] = {}


def register(where: dict[str, Callable], name: str) -> Callable:
    def add(f: Callable) -> Callable:
        where[name] = f
        return f

    return add


@register(FILTERS, "remove_small_objects")
def remove_small_objects(objects: DataFrame, runs: DataFrame, min_size: int = 64) -> DataFrame:
    """Objects with at least ``min_size`` indices. ``objects`` and ``runs`` share the column node."""
    big = areas(runs, ["node"]).filter(F.col("area") >= min_size).select("node")
    return objects.join(big, "node", "left_semi")


@register(FILTERS, "remove_pancakes")
def remove_pancakes(objects: DataFrame, runs: DataFrame, min_span: int = 4) -> DataFrame:
    """Objects whose 3D box spans at least ``min_span`` on every axis."""
    span = F.least(*[F.col(f"{a}2") - F.col(f"{a}1") for a in "zyx"])
    return objects.filter(span >= min_span)


def apply_filters(objects: DataFrame, runs: DataFrame, filters: list[dict]) -> DataFrame:
    """Filters by name, in the order given: [{'name': ..., parameters}]."""
    for f in filters:
        name = f["name"]
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name!r}; known: {', '.join(sorted(FILTERS))}")
        objects = FILTERS[name](objects, runs, **{k: v for k, v in f.items() if k != "name"})
    return objects


for _name, _f in (("semantic_iou", metrics.semantic_iou), ("evaluate", metrics.evaluate), ("dense_iou", metrics.dense_iou), ("dense_scores", metrics.dense_scores), ("ema", metrics.ema)):
    register(METRICS, _name)(_f)


@register(AUGMENTATIONS, "flip_rows")
def flip_rows(pixels: DataFrame, height: int) -> DataFrame:
    return pixels.withColumn("y", F.lit(height - 1) - F.col("y"))


@register(AUGMENTATIONS, "flip_columns")
def flip_columns(pixels: DataFrame, width: int) -> DataFrame:
    return pixels.withColumn("x", F.lit(width - 1) - F.col("x"))


@register(AUGMENTATIONS, "turn")
def turn(pixels: DataFrame, height: int) -> DataFrame:
    """A quarter turn clockwise of images of that height."""
    return pixels.withColumn("_y", F.col("x")).withColumn("x", F.lit(height - 1) - F.col("y")).withColumn("y", F.col("_y")).drop("_y")


@register(AUGMENTATIONS, "window")
def window(pixels: DataFrame, y: int, x: int, height: int, width: int) -> DataFrame:
    return crop(pixels, y, x, y + height, x + width)


@register(AUGMENTATIONS, "scale")
def scale(pixels: DataFrame, factor: int) -> DataFrame:
    return upsample(pixels, factor)


@register(AUGMENTATIONS, "brightness_contrast")
def brightness_contrast(pixels: DataFrame, brightness: float = 0.0, contrast: float = 0.0, value: str = "value") -> DataFrame:
    """Contrast around the middle of 0..255, then brightness as a share of 255; cut off at both ends."""
    v = (F.col(value) - 127.5) * (1 + contrast) + 127.5 + brightness * 255
    return pixels.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)))


def augment(pixels: DataFrame, steps: list[dict]) -> DataFrame:
    """Registered augmentations of pixel tables, in the order given: [{'name': ..., parameters}].

    ``when`` in a step restricts it to the pixels of that condition; ``chance`` to a seeded share of the values of column
    ``image`` (default slice), so that an image is altered as a whole.
    """
    for step in steps:
        rest = {k: v for k, v in step.items() if k not in ("name", "when", "chance", "seed", "image")}
        f, chosen = AUGMENTATIONS[step["name"]], step.get("when")
        if "chance" in step:
            u = F.shiftrightunsigned(F.xxhash64(F.lit(step.get("seed", 0)).cast("bigint"), step.get("image", "slice")), 11).cast("double") / F.lit(float(2**53))
            chosen = u < step["chance"] if chosen is None else chosen & (u < step["chance"])
        if chosen is None:
            pixels = f(pixels, **rest)
        else:
            pixels = f(pixels.filter(chosen), **rest).unionByName(pixels.filter(~F.coalesce(chosen, F.lit(False))))
    return pixels


def measure(name: str, *tables, **parameters) -> DataFrame:
    """A registered metric by its name."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[name](*tables, **parameters)


def infer(images: DataFrame, model: str, schema: str, **options) -> DataFrame:
    """Output of a registered model: a factory of a function from pandas batches to pandas batches, made once for each task."""
    make = MODELS[model]

    def run(batches):
        predict = make(**options)
        for pdf in batches:
            yield predict(pdf)

    return images.mapInPandas(run, schema)
