"""What the image operators share: grey levels, readable and blank arrays, paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of arrays that are worked on at once.
CELLS_AT_ONCE = 1_000_000


def readable(data: str, dtype: str, *dims: Column) -> Column:
    """The array is there, its dimensions are positive, and it has exactly the bytes they and the type call for."""
    cells, there = F.lit(1).cast("bigint"), F.lit(True)
    for d in dims:
        cells, there = F.try_multiply(cells, d.cast("bigint")), there & (d > 0)
    width = F.when(F.col(dtype) == "uint8", 1).when(F.col(dtype) == "uint16", 2)
    return F.coalesce(there & (F.octet_length(data) == F.try_multiply(cells, width)), F.lit(False))


def extent(low: str, high: str) -> Column:
    """high - low, as bigint."""
    return F.col(high).cast("bigint") - F.col(low).cast("bigint")


def grey(data: bytes, wide: bool) -> np.ndarray:
    """Grey levels: a uint8 as it is, a uint16 (little-endian) divided by 257, rounded down."""
    if wide:
        return (np.frombuffer(data, "<u2") // 257).astype(np.uint8)
    return np.frombuffer(data, np.uint8)


def blank(levels: np.ndarray) -> bool:
    return int(levels.max()) - int(levels.min()) <= 3


def usable(patches: DataFrame) -> DataFrame:
    """(patch_id, h, w, wide, image) of rows with an id and a readable image, in the order that level_groups wants."""
    h, w = extent("y0", "y1"), extent("x0", "x1")
    return patches.filter(F.col("patch_id").isNotNull() & readable("image", "dtype", h, w)).select("patch_id", h.cast("int").alias("h"), w.cast("int").alias("w"), (F.col("dtype") == "uint16").alias("wide"), "image")


def level_groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(places in the batch, grey levels with a row for each image, h, w) of images of equal size that are not blank.

    The first columns of the batch are patch_id, h, w, wide and image; arrays of one size are worked on together, at most CELLS_AT_ONCE cells.
    """
    h, w, wide = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
    image = batch.column(4)
    order = np.lexsort((wide, w, h))
    new = np.flatnonzero(np.append(True, (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0) | (np.diff(wide[order]) != 0))) if len(order) else []
    for a, z in zip(new, [*new[1:], len(order)]):
        rows, cols, kind = int(h[order[a]]), int(w[order[a]]), bool(wide[order[a]])
        step = max(1, CELLS_AT_ONCE // (rows * cols))
        for k in range(a, z, step):
            at = order[k : min(k + step, z)]
            levels = grey(b"".join(image.take(pa.array(at)).to_pylist()), kind).reshape(len(at), rows * cols)
            seen = levels.max(axis=1).astype(np.int16) - levels.min(axis=1).astype(np.int16) > 3
            if seen.any():
                yield at[seen], levels[seen], rows, cols


def clean_path(path: Column) -> Column:
    """A path without repeated and trailing slashes and ``.`` steps; null if nothing is left."""
    steps = F.filter(F.split(F.trim(path), "/"), lambda x: (x != "") & (x != "."))
    lead = F.when(F.trim(path).startswith("/"), "/").otherwise("")
    return F.when(F.size(steps) > 0, F.concat(lead, F.array_join(steps, "/")))


def parents(path: Column) -> Column:
    """All directories a path (see clean_path) is below."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
