"""Connected components by contraction and alternating stars, and the overlap graphs of objects.

Each task first contracts its own edges to stars by a union-find of bounded size, and fewer tasks contract those stars
again as long as the bound holds; a graph of which one part is left is done by then. Else it goes on in rounds. In a large star every vertex sends its greater neighbours to its least one; in a small star it sends itself and its smaller
neighbours there. Alternated until nothing changes, what is left are stars around each component's least vertex.
Minima use partial aggregation; joins on a hub are spread (spanlattice.operators.skew). Each round is a table written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlattice.operators.boxes import D2, Dims, cross_source_pairs
from spanlattice.operators.runs import areas, cut_at_edges, overlaps
from spanlattice.operators.skew import lookup
from spanlattice.session import Scratch


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


#: Vertices of a task's union-find; beyond, it gives what it has and begins anew.
UNITED = 2_000_000
#: Parts whose stars one task contracts further.
FAN_IN = 32


def _united(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Stars (v, component, part) of the task's edges, at most about ``most`` vertices in a part; the smaller root stays."""
    part = TaskContext.get().partitionId() << 32
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[y]
        return x

    def stars() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64()), pa.array([part] * len(up), pa.int64())], ["v", "component", "part"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            up[max(a, c)] = min(a, c)
            if len(up) >= most:
                yield stars()
                up.clear()
                part += 1
    if up:
        yield stars()


def components(edges: DataFrame, scratch: Scratch, plain_rows: int | None = None, united: int = UNITED) -> DataFrame:
    """(v, component) for each vertex with an edge to another one; component is the least vertex it is linked to.

    ``edges`` has bigint columns u, v; nulls, loops, repeated and reversed edges change nothing. Empty edges give no row. ``plain_rows`` see skew.lookup,
    ``united`` see UNITED.
    """
    first = scratch.keep(_tidy(edges.filter("u is not null and v is not null")))
    contract = lambda df: scratch.keep(df.mapInArrow(lambda it: _united(it, united), "v bigint, component bigint, part bigint"))
    stars, before = contract(first), None
    scratch.drop(first)
    while True:  # fewer and fewer tasks, as long as what they hold together stays bounded
        n, parts = stars.agg(F.count(F.lit(1)), F.countDistinct("part")).first()
        if parts < 2:
            return stars.select("v", "component")
        tasks = -(-parts // FAN_IN)
        if n > united * tasks or (before is not None and parts >= before):
            break
        before, fewer = parts, contract(stars.select("v", "component").coalesce(tasks))
        scratch.drop(stars)
        stars = fewer
    e = scratch.keep(_tidy(stars.select(F.col("v").alias("u"), F.col("component").alias("v"))))
    scratch.drop(stars)
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = mark(e)
    while now[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = lookup(both, "u", least, "k", "m", 2 * now[0], F.xxhash64("u", "v"), plain_rows=plain_rows).filter("v > u")
        e2 = scratch.keep(_tidy(large.select(F.col("v").alias("u"), F.col("m").alias("v"))))
        least = e2.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = lookup(e2, "u", least, "k", "m", now[0], F.xxhash64("u", "v"), plain_rows=plain_rows)
        e3 = scratch.keep(_tidy(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))))
        was, now = now, mark(e3)
        scratch.drop(e)
        scratch.drop(e2)
        e = e3
        if now == was:
            break
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionAll(e.select("v", F.col("v").alias("component")).distinct())


def overlap_edges(objects: DataFrame, runs: DataFrame, dims: Dims | None = D2, bucket: int = 1 << 10, cell: int = 1 << 12) -> DataFrame:
    """(u, v, iou, overlap), u < v: objects of different sources with a common index.

    ``objects``: (node, source, box columns); ``runs``: (node, s, e), disjoint per node. With ``dims`` the boxes screen the objects first;
    runs of objects without any candidate never enter the interval join.
    """
    runs = runs.select("node", "s", "e")
    r = runs.join(objects.select("node", "source"), "node")
    if dims is not None:
        pairs = cross_source_pairs(objects, "source", "node", dims, cell).select("a_node", "b_node")
        wanted = pairs.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct()
        r = r.join(wanted, "node", "left_semi")
    a = r.select(F.col("node").alias("u"), F.col("source").alias("su"), "s", "e")
    b = r.select(F.col("node").alias("v"), F.col("source").alias("sv"), "s", "e")
    met = overlaps(a, ["u", "su"], b, ["v", "sv"], on=(F.col("u") < F.col("v")) & (F.col("su") != F.col("sv")), bucket=bucket)
    inter = met.groupBy("u", "v").agg(F.sum("inter").alias("overlap"))
    if dims is not None:
        inter = inter.join(pairs.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")), ["u", "v"], "left_semi")
    size = areas(runs, ["node"])
    out = inter.join(size.select(F.col("node").alias("u"), F.col("area").alias("nu")), "u").join(size.select(F.col("node").alias("v"), F.col("area").alias("nv")), "v")
    return out.select("u", "v", (F.col("overlap") / (F.col("nu") + F.col("nv") - F.col("overlap")).cast("double")).alias("iou"), "overlap")


#: Indices of a block of the sweep that links objects.
SWEEP = 1 << 18


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) from rows (block, s, e, node, source) sorted by block and start.

    A range meets all ranges of other sources that are still open where it starts. Those of a source that once met one are in one component, so from then on the one that ends last
    stands for them: each range is looked at once, and links number less than the nodes of a block.
    """
    now, open_, up = None, {}, {}
    us, vs = [], []

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[y]
        return x

    def link(u: int, v: int) -> None:
        a, b = find(u), find(v)
        if a != b:
            up[max(a, b)] = min(a, b)
            us.append(u)
            vs.append(v)

    for batch in batches:
        for block, s, e, node, source in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now:
                now, open_, up = block, {}, {}
            for other, held in open_.items():
                if other != source and held:
                    last = None
                    for x in held:
                        if x[0] > s:
                            link(node, x[1])
                            last = x if last is None or x[0] > last[0] else last
                    held[:] = [] if last is None else [last]
            open_.setdefault(source, []).append((e, node))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
        us.clear()
        vs.clear()


def overlap_links(runs: DataFrame, block: int = SWEEP) -> DataFrame:
    """(u, v) that join the same objects to components as all edges of overlap_edges do (without boxes), by a sweep instead of a list of pairs.

    ``runs``: (node bigint, source, s, e).
    """
    cut = cut_at_edges(runs.filter("node is not null and source is not null"), ["node", "source"], block).select("block", "s", "e", "node", "source")
    return cut.repartition("block").sortWithinPartitions("block", "s").mapInArrow(_linked, "u bigint, v bigint")


def with_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` (node, ...) with ``component``; a node without an edge is its own component."""
    c = components(edges.select("u", "v"), scratch).withColumnRenamed("v", "node")
    return nodes.join(c, "node", "left").withColumn("component", F.coalesce("component", "node"))


def cluster_edges(members: DataFrame, edges: DataFrame, min_iou: float = 0.01, min_overlap: float = 100) -> DataFrame:
    """(c1, c2, iou, overlap), c1 < c2: the mean edge over all pairs across two clusters, a missing edge counting as 0.

    ``members``: (node, cluster). Kept if the mean iou is above ``min_iou`` or the mean overlap above ``min_overlap``.
    """
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    of = lambda end, c: members.select(F.col("node").alias(end), F.col("cluster").alias(c))
    across = edges.join(of("u", "cu"), "u").join(of("v", "cv"), "v").filter("cu <> cv")
    sums = across.groupBy(F.least("cu", "cv").alias("c1"), F.greatest("cu", "cv").alias("c2")).agg(F.sum("iou").alias("wi"), F.sum("overlap").alias("wo"))
    n = lambda c, as_: size.select(F.col("cluster").alias(c), F.col("n").alias(as_))
    cells: Column = (F.col("n1") * F.col("n2")).cast("double")
    mean = sums.join(n("c1", "n1"), "c1").join(n("c2", "n2"), "c2").select("c1", "c2", (F.col("wi") / cells).alias("iou"), (F.col("wo") / cells).alias("overlap"))
    return mean.filter((F.col("iou") > min_iou) | (F.col("overlap") > min_overlap))
