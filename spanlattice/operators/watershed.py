"""Instances from foreground and contour probabilities: seeds by thresholds and components, then a flood per foreground component.

Voxel tables: (z, y, x, ...). Seeds and floods never leave a connected part of the foreground, so each part is a group of its own; a part is as big
as one clump of touching objects.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlattice.operators.graph import components
from spanlattice.operators.grouping import by_key
from spanlattice.operators.numbering import number_rows
from spanlattice.session import Scratch


def voxel_components(voxels: DataFrame, scratch: Scratch, diagonal: bool = True) -> DataFrame:
    """(z, y, x, component): connected voxels, over corners (26 neighbours) or faces only (6); numbered by the first run of each.

    Runs along x are the vertices of the graph, linked to runs of neighbouring rows.
    """
    k = F.col("x") - F.row_number().over(W.partitionBy("z", "y").orderBy("x"))
    runs = voxels.select("z", "y", "x").distinct().withColumn("_k", k).groupBy("z", "y", "_k").agg(F.min("x").alias("s"), (F.max("x") + 1).alias("e")).drop("_k")
    runs = scratch.keep(number_rows(runs, ["z", "y", "s"], "run", scratch))
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)] if diagonal else [(0, 1), (1, 0)]
    to = F.explode(F.array(*[F.struct((F.col("z") + dz).alias("z"), (F.col("y") + dy).alias("y")) for dz, dy in steps]))
    reach = 1 if diagonal else 0
    width = 64
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    a = runs.select(F.col("run").alias("u"), F.col("s").alias("s1"), F.col("e").alias("e1"), to.alias("t")).select("u", "s1", "e1", "t.z", "t.y", cells(F.col("s1") - reach, F.col("e1") - 1 + reach).alias("_b"))
    b = runs.select(F.col("run").alias("v"), F.col("s").alias("s2"), F.col("e").alias("e2"), "z", "y", cells(F.col("s"), F.col("e") - 1).alias("_b"))
    touch = (F.col("s1") < F.col("e2") + reach) & (F.col("s2") < F.col("e1") + reach)
    got = components(a.join(b, ["z", "y", "_b"]).filter(touch).select("u", "v"), scratch).withColumnRenamed("v", "run")
    named = runs.join(got, "run", "left").withColumn("component", F.coalesce("component", "run"))
    return named.select("z", "y", "component", F.explode(F.sequence("s", F.col("e") - 1)).alias("x")).select("z", "y", "x", "component")


def drop_small(voxels: DataFrame, label: str | list[str], least: int) -> DataFrame:
    """Voxels of labels (or label columns together) with at least ``least`` voxels."""
    label = [label] if isinstance(label, str) else label
    big = voxels.groupBy(*label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*label)
    return voxels.join(big, label, "left_semi")


def flood(cells: list[tuple[int, int, int]], seeds: dict[tuple[int, int, int], int], height: dict[tuple[int, int, int], float] | None) -> dict[tuple[int, int, int], int]:
    """Labels of the cells that the seeds reach over faces, the lowest ``height`` first, then the earliest reached, then in raster order.

    Without ``height`` only the order of reaching counts: every cell goes to a seed with the fewest steps.
    """
    inside, out = set(cells), dict(seeds)
    age = 0
    heap = [(height[c] if height else 0.0, 0, c) for c in sorted(seeds) if c in inside or height is None]
    heapq.heapify(heap)
    while heap:
        _, _, (z, y, x) = heapq.heappop(heap)
        age += 1
        for near in ((z - 1, y, x), (z, y - 1, x), (z, y, x - 1), (z, y, x + 1), (z, y + 1, x), (z + 1, y, x)):
            if near in inside and near not in out:
                out[near] = out[(z, y, x)]
                heapq.heappush(heap, (height[near] if height else 0.0, age, near))
    return {c: x for c, x in out.items() if c in inside}


def contour_watershed(voxels: DataFrame, seed_fg: float = 0.9, seed_bd: float = 0.8, fg: float = 0.85, seed_size: int = 32, min_size: int | None = 128, divisor: int = 1000, by_steps: bool = False) -> DataFrame:
    """(z, y, x, label) from (z, y, x, sem, bd), probabilities as 0..255.

    Seeds: components (corners included) of sem above int(255 * seed_fg) and bd below int(255 * seed_bd), with ``seed_size`` voxels or more. They flood the
    foreground, sem above int(255 * fg), brightest first, or by number of steps only (``by_steps``). Instances below
    ``min_size`` are dropped; labels are the seeds' numbers plus ``divisor``. Rows with a null are background.
    """
    scratch = Scratch(voxels.sparkSession, "watershed")
    v = scratch.keep(voxels.select("z", "y", "x", "sem", "bd").dropna())  # what makes them may be many more rows than Spark estimates
    seed_cells = v.filter((F.col("sem") > int(255 * seed_fg)) & (F.col("bd") < int(255 * seed_bd)))
    seeds = scratch.keep(drop_small(voxel_components(seed_cells, scratch), "component", seed_size))
    order = scratch.keep(number_rows(seeds.select("component").distinct(), ["component"], "seed", scratch))
    ground = voxel_components(v.filter(F.col("sem") > int(255 * fg)), scratch, diagonal=False).withColumnRenamed("component", "part")
    named = seeds.join(order, "component").select("z", "y", "x", "seed")
    cells = scratch.keep(ground.join(v.select("z", "y", "x", "sem"), ["z", "y", "x"]).join(named, ["z", "y", "x"], "left"))
    seeded = cells.filter("seed is not null").select("part").distinct()

    def grow(rows: list[tuple]) -> list[tuple]:
        own = {r[1:4]: r[5] for r in rows if r[5] is not None}
        got = flood([r[1:4] for r in rows], own, None if by_steps else {r[1:4]: -float(r[4]) for r in rows})
        return [(*c, s) for c, s in got.items()]

    schema = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("z", "y", "x")) + ", label bigint"
    grown = scratch.keep(by_key(cells.join(seeded, "part", "left_semi").select("part", "z", "y", "x", "sem", "seed"), "part", grow, schema))
    kept = grown if min_size is None else drop_small(grown, "label", min_size)
    return scratch.handed(kept.select("z", "y", "x", (F.col("label") + divisor).alias("label")))
