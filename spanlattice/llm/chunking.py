"""Splitting oversized arrays at natural boundaries, with an overlap: content-defined chunking over whole lines.

A piece may end before any line from its least to its greatest length. Its target is the first landmark there, a
place where a rolling hash of the lines just before has its low bits zero; without one it is the greatest length. The cut snaps to
the natural boundary nearest to the target; without one it is the target itself. Landmarks depend on the content around them only, so an
edit alters the pieces near it and the later ones fall back into the old cuts.

With ``landmark_bits=None`` there are no landmarks: the target is always the size limit, so a cut is the last natural boundary that fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlattice.llm.images import grey, readable

#: Lines in the window of the rolling hash.
WINDOW = 3
#: Base of the rolling hash; odd, so that it has an inverse.
BASE = 0xBF58476D1CE4E5B9


def natural_boundaries(lines: np.ndarray) -> np.ndarray:
    """For each line z, whether there is a natural boundary before it: z > 0, and line z or line z - 1 is blank."""
    still = (lines.max(axis=1).astype(np.int16) - lines.min(axis=1).astype(np.int16)) <= 3
    return np.concatenate([[False], still[1:] | still[:-1]])


def landmarks(lines: np.ndarray, bits: int) -> np.ndarray:
    """For each line z, whether the rolling hash of the WINDOW lines before it has its low ``bits`` zero."""
    powers = np.cumprod(np.full(lines.shape[1], 0x9E3779B97F4A7C15, np.uint64))
    digest = (lines.astype(np.uint64) * powers + np.uint64(1)).sum(axis=1, dtype=np.uint64)
    digest ^= digest >> np.uint64(29)
    # the window's hash sum(digest[i] * BASE^(z - i)) rolls from line to line; all at once it is a difference of running sums, times BASE^z
    n = len(lines)
    back = np.cumprod(np.full(n, pow(BASE, -1, 2**64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest * back, dtype=np.uint64)])
    rolled = total.copy()
    rolled[WINDOW:] -= total[: n + 1 - WINDOW]
    rolled *= np.cumprod(np.full(n + 1, BASE, np.uint64))
    out = (rolled >> np.uint64(64 - bits)) == 0
    out[:WINDOW] = False
    return out[: len(lines)]


def cut(n: int, natural: np.ndarray, marks: np.ndarray | None, most: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces [begin, end) of n lines. A line wider than the limit is a piece of its own (most counts as 1)."""
    most = max(most, 1)
    least = min(least, most)
    at, begin, out = np.flatnonzero(natural), 0, []
    marked = np.flatnonzero(marks) if marks is not None else np.zeros(0, np.int64)
    while n - begin > most:
        low, high = begin + least, begin + most
        i = np.searchsorted(marked, low)
        target = int(marked[i]) if i < len(marked) and marked[i] <= high else high
        i = int(np.searchsorted(at, target, "right"))
        near = [int(x) for x in at[max(i - 1, 0) : i + 1] if low <= x <= high]
        end = min(near, key=lambda x: (abs(x - target), -x)) if near else target
        out.append((begin, end))
        begin = max(end - overlap, begin + 1)
    out.append((begin, n))
    return out


def pieces(df: DataFrame, kind: str, item: str, data: str, dtype: str, n_lines: Column, line_cells: Column, limit: int, overlap: int = 2, least: int = 3, landmark_bits: int | None = None) -> DataFrame:
    """Rows (item_kind, item_id, piece_no, first_line, end_line), half-open, of arrays with more than ``limit`` cells.

    Pieces are whole lines, at most ``limit`` cells together (but see cut for a single line above the limit); each after the first
    begins ``overlap`` lines before the end of the one before, and at least one line after its beginning. Null ids and
    arrays that are not readable are left out; ids delivered repeatedly count once (the least list of pieces if
    their arrays differ); empty tables give no row; further columns are not read.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, firsts, ends = [], [], []
            for i, array, wide, n, cells in zip(pdf["item_id"], pdf["data"], pdf["wide"], pdf["n"], pdf["cells"]):
                lines = grey(array, wide).reshape(n, cells)
                got = cut(n, natural_boundaries(lines), None if landmark_bits is None else landmarks(lines, landmark_bits), limit // cells, least, overlap)
                ids.append(i)
                firsts.append([a for a, _ in got])
                ends.append([b for _, b in got])
            yield pd.DataFrame({"item_id": np.array(ids, np.int64), "firsts": firsts, "ends": ends})

    usable = df.filter(F.col(item).isNotNull() & readable(data, dtype, n_lines, line_cells)).filter(F.try_multiply(n_lines.cast("bigint"), line_cells.cast("bigint")) > limit)
    cuts = usable.select(F.col(item).alias("item_id"), n_lines.cast("int").alias("n"), line_cells.cast("int").alias("cells"), (F.col(dtype) == "uint16").alias("wide"), F.col(data).alias("data"))
    cuts = cuts.mapInPandas(make, "item_id bigint, firsts array<int>, ends array<int>")
    once = cuts.groupBy("item_id").agg(F.min(F.struct("firsts", "ends")).alias("x"))  # small lists only are shuffled
    each = once.select("item_id", F.posexplode(F.arrays_zip("x.firsts", "x.ends")).alias("piece_no", "p"))
    return each.select(F.lit(kind).alias("item_kind"), "item_id", "piece_no", F.col("p.firsts").alias("first_line"), F.col("p.ends").alias("end_line"))


def edited_pieces(df: DataFrame, kind: str, item: str, data: str, dtype: str, n_lines: Column, line_cells: Column, limit: int, overlap: int = 2, least: int = 3, landmark_bits: int | None = None) -> DataFrame:
    """Rows (item_kind, item_id, n_lines, n_before, n_after, n_altered): what a planted edit does to the pieces of each item that pieces() cuts.

    The edit puts a line, the item's middle line with its levels turned round (255 - level), before the middle line. A piece of the edited item is
    altered if its lines are not those of a piece of the item as it was: pieces after the edit are compared at the old places of their lines.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, array, wide, n, cells in zip(pdf["item_id"], pdf["data"], pdf["wide"], pdf["n"], pdf["cells"]):
                lines, mid = grey(array, wide).reshape(n, cells), n // 2
                after = np.concatenate([lines[:mid], 255 - lines[mid : mid + 1], lines[mid:]])
                was, now = ([(a, b) for a, b in cut(len(x), natural_boundaries(x), None if landmark_bits is None else landmarks(x, landmark_bits), limit // cells, least, overlap)] for x in (lines, after))
                old = {(a - (a > mid), b - (b > mid)) if b <= mid or a > mid else None for a, b in now}
                kept = sum(p in old for p in set(was))
                out.append((i, n, len(was), len(now), len(now) - kept))
            yield pd.DataFrame(out, columns=["item_id", "n_lines", "n_before", "n_after", "n_altered"]).astype({"item_id": "int64"})

    usable = df.filter(F.col(item).isNotNull() & readable(data, dtype, n_lines, line_cells)).filter(F.try_multiply(n_lines.cast("bigint"), line_cells.cast("bigint")) > limit)
    rows = usable.select(F.col(item).alias("item_id"), n_lines.cast("int").alias("n"), line_cells.cast("int").alias("cells"), (F.col(dtype) == "uint16").alias("wide"), F.col(data).alias("data"))
    got = rows.mapInPandas(make, "item_id bigint, n_lines int, n_before int, n_after int, n_altered int").dropDuplicates(["item_id"])
    return got.select(F.lit(kind).alias("item_kind"), *got.columns)
