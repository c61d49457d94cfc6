"""Maximum-weight one-to-one assignment of sparse pairs.

Pairs without weight never matter for the sum, so the problem splits by connected component of the pair graph: components
of one pair need no search; the others are solved each in one group, as big as the objects that overlap in a chain. The
search keeps the pairs only, never a matrix.
"""

from __future__ import annotations

from collections.abc import Hashable, Mapping
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlattice.operators.graph import components
from spanlattice.operators.grouping import by_key
from spanlattice.session import Scratch


def best_pairs(weight: Mapping[tuple[Hashable, Hashable], float]) -> set[tuple]:
    """The pairs (left, right) of the assignment with the greatest sum; pairs whose weight is not above 0 are left out.

    Left labels enter one after the other, each along the alternating path that gains most (Dijkstra over reduced costs
    on the given pairs); a path may also end by leaving a left label without a partner, at no gain.
    """
    near: dict = {}
    for (x, y), w in weight.items():
        if w > 0:
            near.setdefault(x, []).append((y, float(w)))
    gain = {x: max(w for _, w in ys) for x, ys in near.items()}  # price of a left label, never below what a pair of it is worth
    price: dict = {}  # of a right label, at least 0, and 0 as long as it is free
    partner: dict = {}  # of a right label
    taken: dict = {}  # of a left label
    for start in sorted(near):
        cost, came, done = {start: 0.0}, {}, set()
        heap: list = [(0.0, 0, start)]
        ends: tuple | None = None  # (cost, kind, label): a free right label, or a left label that goes without
        settled: list = []
        seen = 0
        while heap:
            d, _, x = heappop(heap)
            if ends is not None and d >= ends[0]:
                break
            if x in done:
                continue
            done.add(x)
            settled.append((x, d))
            if ends is None or d + gain[x] < ends[0]:
                ends = (d + gain[x], "left", x)
            for y, w in near[x]:
                if taken.get(x) == y:
                    continue
                c = d + gain[x] + price.get(y, 0.0) - w  # not below 0 but for rounding
                if y not in partner:
                    if c < ends[0]:
                        ends = (c, "right", y)
                        came[("free", y)] = x
                elif c < cost.get(partner[y], float("inf")) and partner[y] not in done:
                    cost[partner[y]] = c
                    came[partner[y]] = (x, y)
                    seen += 1
                    heappush(heap, (c, seen, partner[y]))
        total, kind, at = ends
        for x, d in settled:  # prices stay feasible, and tight along the paths found
            if d < total:
                gain[x] -= total - d
                if x in taken:
                    price[taken[x]] = price.get(taken[x], 0.0) + total - d
        x, y = (came[("free", at)], at) if kind == "right" else (at, None)
        while True:
            before = taken.get(x)
            if y is None:
                taken.pop(x, None)
            else:
                taken[x], partner[y] = y, x
            if x == start:
                break
            x, y = came[x][0], before
    return {(x, y) for x, y in taken.items()}


def assign(pairs: DataFrame, keys: list[str], left: str, right: str, weight: str, scratch: Scratch, threshold: float | None = None) -> DataFrame:
    """The rows of ``pairs`` (keys, left, right, weight > 0) in the best assignment of each key; then those of at least ``threshold``.

    left and right are bigint labels, keys non-null. The threshold comes after the search, so a good pair may give way to two
    worse ones with a greater sum. Among equal sums the pairs first in label order are preferred by the search.
    """
    cols = [*keys, left, right, weight]
    p = scratch.keep(pairs.select(*cols).filter(F.col(weight) > 0).dropDuplicates([*keys, left, right]))
    vertex = lambda side, c: F.xxhash64(F.lit(side), *keys, c)
    p = p.withColumn("_u", vertex("l", left)).withColumn("_v", vertex("r", right))
    comp = components(p.select(F.col("_u").alias("u"), F.col("_v").alias("v")), scratch)
    p = scratch.keep(p.join(comp.select(F.col("v").alias("_u"), "component"), "_u").drop("_u", "_v"))
    alone = p.groupBy("component").count().filter("count = 1").select("component")

    at = [["component", *cols].index(c) for c in (left, right, weight)]

    def solve(rows: list[tuple]) -> list[tuple]:
        chosen = best_pairs({(r[at[0]], r[at[1]]): r[at[2]] for r in rows})
        return [r[1:] for r in rows if (r[at[0]], r[at[1]]) in chosen]

    single = p.join(alone, "component", "left_semi").select(*cols)
    many = by_key(p.join(alone, "component", "left_anti").select("component", *cols), "component", solve, p.select(*cols).schema)
    out = single.unionAll(many)
    return out if threshold is None else out.filter(F.col(weight) >= threshold)
