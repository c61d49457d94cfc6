"""Tiling of large images: layout, overlap regions, cutting and moving runs between tile and image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlattice.operators.runs import block_of, cut_at_edges, join_ranges, overlaps


def spans(length: int, tile: int, overlap: int) -> list[tuple[int, int]]:
    """Tiles of one size, the fewest that overlap by at least ``overlap``, with starts evenly spaced; one tile if it holds everything."""
    if tile >= length:
        return [(0, length)]
    if tile <= overlap:
        raise ValueError("tiles must be larger than their overlap")
    n = -(-(length - overlap) // (tile - overlap))
    return [(s, s + tile) for s in (round(k * (length - tile) / (n - 1)) for k in range(n))]


def layout(spark: SparkSession, height: int, width: int, tile: tuple[int, int] = (2048, 2048), overlap: int = 128) -> DataFrame:
    """(tile, y0, y1, x0, x1), row by row from 0."""
    at = [(a, b) for a in spans(height, tile[0], overlap) for b in spans(width, tile[1], overlap)]
    return spark.createDataFrame([(i, a[0], a[1], b[0], b[1]) for i, (a, b) in enumerate(at)], "tile int, y0 int, y1 int, x0 int, x1 int")


def overlap_region(spark: SparkSession, height: int, width: int, tile: tuple[int, int], overlap: int) -> DataFrame:
    """(s, e) of the image's indices that two tile rows or two tile columns share."""
    doubled = lambda sp: [(b, min(a2, b2)) for (_, a2), (b, b2) in zip(sp, sp[1:]) if b < a2]
    ys, xs = doubled(spans(height, tile[0], overlap)), doubled(spans(width, tile[1], overlap))
    bands = spark.createDataFrame([(a * width, b * width) for a, b in ys] or [(0, 0)], "s bigint, e bigint")
    rows = spark.range(height).select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in xs] or [F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))])).alias("c"))
    columns = rows.select((F.col("id") * width + F.col("c.a")).alias("s"), (F.col("id") * width + F.col("c.b")).alias("e"))
    both = bands.unionAll(columns).filter("s < e").withColumn("k", F.lit(0))
    return join_ranges(both, ["k"]).select("s", "e")


#: Rows of an image in a bucket of the joins with tiles.
ROWS = 64


def _by_rows(tiles: DataFrame) -> DataFrame:
    """Each tile once for each bucket of rows it touches."""
    return tiles.withColumn("_rows", F.explode(F.sequence(block_of(F.col("y0").cast("bigint"), ROWS), block_of((F.col("y1") - 1).cast("bigint"), ROWS))))


def crop_pixels(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels of each tile in the tile's own coordinates."""
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    met = pixels.withColumn("_rows", block_of(F.col("y").cast("bigint"), ROWS)).join(_by_rows(tiles), "_rows").filter(inside)
    return met.withColumn("y", F.col("y") - F.col("y0")).withColumn("x", F.col("x") - F.col("x0")).drop("y0", "y1", "x0", "x1", "_rows")


def to_image(runs: DataFrame, tiles: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Runs (keys, tile, s, e) of tiles in the image's indices; cut at the tile's row ends first."""
    local = runs.join(tiles, "tile").select(*keys, "tile", "y0", "x0", (F.col("x1") - F.col("x0")).alias("tw"), F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e")).filter("s < e")
    rows = local.withColumn("r", F.explode(F.sequence(F.floor(F.col("s") / F.col("tw")), F.floor((F.col("e") - 1) / F.col("tw")))))
    at = (F.col("r") + F.col("y0")) * width + F.col("x0") - F.col("r") * F.col("tw")
    moved = rows.select(*keys, "tile", (F.greatest("s", F.col("r") * F.col("tw")) + at).alias("s"), (F.least("e", (F.col("r") + 1) * F.col("tw")) + at).alias("e"))
    return join_ranges(moved, [*keys, "tile"])


def to_tiles(runs: DataFrame, tiles: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Runs (keys, s, e) of the image cut to each tile, in the tile's indices."""
    rows = cut_at_edges(runs, keys, width, "row")
    met = rows.withColumn("_rows", block_of(F.col("row"), ROWS)).join(_by_rows(tiles), "_rows").filter((F.col("row") >= F.col("y0")) & (F.col("row") < F.col("y1")))
    a, b = F.greatest(F.col("s") - F.col("row") * width, F.col("x0")), F.least(F.col("e") - F.col("row") * width, F.col("x1"))
    base = (F.col("row") - F.col("y0")) * (F.col("x1") - F.col("x0")) - F.col("x0")
    local = met.select(*keys, "tile", (a + base).alias("s"), (b + base).alias("e")).filter("s < e")
    return join_ranges(local, [*keys, "tile"])


def clip_to_windows(runs: DataFrame, windows: DataFrame, keys: list[str], bucket: int = 1 << 10) -> DataFrame:
    """(keys, tile, s, e): runs cut to 1D windows (tile, s, e), in the window's own indices."""
    met = overlaps(runs, keys, windows, ["tile"], bucket=bucket)
    low = windows.select("tile", F.col("s").alias("_w"))
    return met.join(low, "tile").select(*keys, "tile", (F.col("s") - F.col("_w")).alias("s"), (F.col("e") - F.col("_w")).alias("e"))
