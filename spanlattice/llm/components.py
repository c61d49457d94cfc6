"""Consolidating pairwise matches into groups: connected components by random contraction.

Each round every vertex hooks to the least of itself and its neighbours in a fresh hash order, edges are relabelled and
deduplicated, and loops dropped; the number of vertices falls by a constant factor, so the rounds grow with the
logarithm of the input. The mappings of the rounds are then expanded from the last back to the first.

xxhash64 of one bigint under a fixed seed is a bijection of 64-bit numbers, so the hash value itself serves as the
label of the next round: a plain minimum (partial aggregation, no struct) finds the representative. Labels of one round are distinct for
distinct vertices, and all roots are brought to the last round's labels, so no two components can ever get one root.
A vertex with a large part of the edges is served by a broadcast of bounded size (spanlattice.operators.skew).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlattice.operators.skew import HOT_KEYS, hot_keys, lookup
from spanlattice.session import Scratch


def match_edges(df: DataFrame, left: str, right: str, weight: str, members: str, threshold: float) -> DataFrame:
    """Edges (u, v) of match rows: a star for each row, from ``left`` or else the first member, to what it links.

    ``left`` and ``right`` are linked if both are given and ``weight`` is a number above ``threshold`` and at most 1
    (not null, not NaN); the elements of ``members`` are linked with each other and with ``left`` if given. Null
    elements, repeated elements and loops make no edge.
    """
    w = F.col(weight)
    matched = w.isNotNull() & ~F.isnan(w) & (w > threshold) & (w <= 1)
    given = F.filter(F.coalesce(F.col(members), F.array().cast("array<bigint>")), lambda x: x.isNotNull())
    # without `left`, the first member is the centre; the match needs `left`, so it never lacks the centre
    star = df.select(F.coalesce(F.col(left), F.try_element_at(given, F.lit(1))).alias("u"), F.concat(given, F.when(matched & F.col(left).isNotNull() & F.col(right).isNotNull(), F.array(F.col(right))).otherwise(F.array().cast("array<bigint>"))).alias("vs"))
    return star.filter(F.col("u").isNotNull()).select("u", F.explode("vs").alias("v")).filter("u <> v")


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _order(round_: int, vertex: str) -> Column:
    return F.xxhash64(F.lit(round_).cast("bigint"), F.col(vertex))


def components(edges: DataFrame, scratch: Scratch, seed: int = 0, plain_rows: int | None = None) -> DataFrame:
    """Rows (v, root) for each vertex with an edge to another one; equal roots for exactly the connected vertices.

    ``edges`` has bigint columns u, v (loops, repeated and reversed edges change nothing); nulls are not allowed.
    Empty edges give no row. ``plain_rows`` see skew.lookup.
    """
    e = scratch.keep(_canonical(edges))
    maps: list[DataFrame] = []
    sizes: list[int] = []
    while n := e.count():
        k = seed + len(maps)
        ends = e.select(F.col("u").alias("v"), _order(k, "v").alias("h")).unionAll(e.select("v", _order(k, "u").alias("h")))
        hook = ends.groupBy("v").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("deg"))
        hook = scratch.keep(hook.select("v", F.least("h", _order(k, "v")).alias("root"), "deg"))
        hot = hook.filter(F.col("deg") > max(2 * n // HOT_KEYS, 1000)).select("v")  # fewer than HOT_KEYS: degrees add up to 2n
        spread = F.xxhash64("u", "v")
        at_u = lookup(e, "u", hook.withColumnRenamed("v", "x"), "x", "root", n, spread, hot.withColumnRenamed("v", "x"), plain_rows).withColumnRenamed("root", "ru")
        at_v = lookup(at_u, "v", hook.withColumnRenamed("v", "x"), "x", "root", n, spread, hot.withColumnRenamed("v", "x"), plain_rows)
        smaller = scratch.keep(_canonical(at_v.select(F.col("ru").alias("u"), F.col("root").alias("v"))))
        scratch.drop(e)
        e = smaller
        maps.append(hook.drop("deg"))
        sizes.append(n)
    if not maps:
        return e.select("v", F.col("u").alias("root"))
    found = maps[-1]
    for k in range(len(maps) - 2, -1, -1):
        up = found.select(F.col("v").alias("x"), F.col("root").alias("top"))
        m = maps[k]
        alone = F.col("root")  # its component was done in round k: like any vertex without an edge, it hooks to itself from then on
        for j in range(k + 1, len(maps)):
            alone = F.xxhash64(F.lit(seed + j).cast("bigint"), alone)
        found = lookup(m, "root", up, "x", "top", sizes[k], F.xxhash64("v", "root"), plain_rows=plain_rows).select("v", F.coalesce("top", alone).alias("root"))
        if k % 3 == 0:
            found = scratch.keep(found)
    return found


def groups(df: DataFrame, left: str, right: str, weight: str, members: str, threshold: float = 0.75, seed: int = 0, plain_rows: int | None = None) -> DataFrame:
    """Rows (node, group_node): each id occurring in ``left``, ``right`` or ``members`` once, with the least id of its group.

    An id linked to none is its own group. Null ids are no nodes; see match_edges for what links. Repeated rows change
    nothing; an empty table gives no row; further columns are not read. ``plain_rows`` see skew.lookup.
    """
    scratch = Scratch(df.sparkSession, "groups")
    df = df.select(F.col(left).cast("bigint").alias("left"), F.col(right).cast("bigint").alias("right"), F.col(weight).cast("double").alias("weight"), F.col(members).cast("array<bigint>").alias("members"))
    root = components(match_edges(df, "left", "right", "weight", "members", threshold), scratch, seed, plain_rows)
    root = scratch.keep(root)
    ids = F.concat(F.array("left", "right"), F.coalesce(F.col("members"), F.array().cast("array<bigint>")))
    nodes = df.select(F.explode(ids).alias("node")).filter("node is not null").distinct()
    least = root.groupBy("root").agg(F.min("v").alias("least"))
    n = root.count()
    named = lookup(root, "root", least.withColumnRenamed("root", "r"), "r", "least", n, F.xxhash64("v"), hot_keys(root, "root", n).withColumnRenamed("root", "r"), plain_rows)
    return scratch.handed(nodes.join(named.select(F.col("v").alias("node"), "least"), "node", "left").select("node", F.coalesce("least", "node").alias("group_node")))
