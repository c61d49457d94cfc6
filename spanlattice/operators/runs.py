"""Algebra of half-open ranges [s, e): encoding, union, voting, complement, intersection, cutting.

A run table has key columns and bigint columns s, e. Operators take the names of the key columns. Sweeps are windows per key and per
block of the index space, and only ranges that touch a block's edge are looked at again to join them across
edges, so that one key with most of the rows is still spread over tasks.

Null keys form a key of their own; ranges with a null or an empty span (e <= s) cover nothing and are left out; repeated
rows and ties change nothing unless said otherwise; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Indices of a block: wide enough that few ranges cross an edge.
BLOCK = 1 << 22
#: Width of the buckets of the interval join; choose it a few times the usual length of a range.
BUCKET = 1 << 10
#: Buckets of one width that a range takes at most, if there is a wider one.
SPREAD = 16


def _real(runs: DataFrame, keys: list[str], s: str = "s", e: str = "e") -> DataFrame:
    return runs.select(*keys, F.col(s).cast("bigint").alias("s"), F.col(e).cast("bigint").alias("e")).filter("s < e")


def block_of(c: Column, size: int) -> Column:
    """c / size, rounded down, in whole numbers."""
    rest = F.pmod(c, F.lit(size).cast("bigint"))
    return F.call_function("div", c - rest, F.lit(size).cast("bigint"))


def cut_at_edges(runs: DataFrame, keys: list[str], size: int, as_block: str | None = "block") -> DataFrame:
    """Ranges cut at the multiples of ``size``; as_block names a column with the number of the block."""
    cut = _real(runs, keys).withColumn("_b", F.explode(F.sequence(block_of(F.col("s"), size), block_of(F.col("e") - 1, size))))
    cut = cut.withColumn("s", F.greatest("s", F.col("_b") * size)).withColumn("e", F.least("e", (F.col("_b") + 1) * size))
    return cut.withColumnRenamed("_b", as_block) if as_block else cut.drop("_b")


def _islands(runs: DataFrame, by: list[str]) -> DataFrame:
    """Union of the ranges of each group; touching ranges become one."""
    order = W.partitionBy(*by).orderBy("s", "e")
    seen = runs.withColumn("_far", F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)))
    seen = seen.withColumn("_new", F.coalesce((F.col("s") > F.col("_far")).cast("int"), F.lit(1)))
    seen = seen.withColumn("_isle", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return seen.groupBy(*by, "_isle").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_isle")


def _over_edges(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Joins disjoint ranges (keys, block, s, e) that touch at block edges.

    The ranges at edges, at most two for each block and key, form one group per key; the others stay in their block's group. One
    more exchange of the ranges, but no second evaluation of what made them.
    """
    at_edge = (F.pmod(F.col("s"), F.lit(size).cast("bigint")) == 0) | (F.pmod(F.col("e"), F.lit(size).cast("bigint")) == 0)
    grouped = parts.select(*keys, "s", "e", F.when(~at_edge, F.col("block")).alias("_group"))
    return _islands(grouped, [*keys, "_group"]).select(*keys, "s", "e")


def join_ranges(runs: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Union per key: maximal disjoint ranges (overlapping and touching ones become one)."""
    parts = _islands(cut_at_edges(runs, keys, block), [*keys, "block"])
    return _over_edges(parts, keys, block)


def vote_ranges(runs: DataFrame, keys: list[str], votes: int, block: int = BLOCK) -> DataFrame:
    """Maximal ranges covered by at least ``votes`` ranges of the key (a range given twice votes twice)."""
    if votes <= 1:
        return join_ranges(runs, keys, block)
    by = [*keys, "block"]
    cut = cut_at_edges(runs, keys, block)
    events = cut.select(*by, F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = events.select(*by, "x.p", "x.d").groupBy(*by, "p").agg(F.sum("d").alias("d"))
    order = W.partitionBy(*by).orderBy("p")
    held = steps.select(*by, F.col("p").alias("s"), F.lead("p").over(order).alias("e"), F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("n"))
    held = held.filter((F.col("n") >= votes) & F.col("e").isNotNull())
    return _over_edges(_islands(held, by), keys, block)


def encode(points: DataFrame, keys: list[str], index: str, block: int = BLOCK) -> DataFrame:
    """Runs of successive indices; null indices are left out and repeated ones count once."""
    at = points.select(*keys, F.col(index).cast("bigint").alias("i")).filter("i is not null").withColumn("block", block_of(F.col("i"), block))
    by = [*keys, "block"]
    at = at.withColumn("_k", F.col("i") - F.dense_rank().over(W.partitionBy(*by).orderBy("i")))  # repeated indices share a rank
    parts = at.groupBy(*by, "_k").agg(F.min("i").alias("s"), (F.max("i") + 1).alias("e"))
    return _over_edges(parts, keys, block)


def decode(runs: DataFrame, keys: list[str], index: str = "idx") -> DataFrame:
    """One row for each index of each range."""
    return _real(runs, keys).select(*keys, F.explode(F.sequence("s", F.col("e") - 1)).alias(index))


def invert(runs: DataFrame, keys: list[str], size: int, block: int = BLOCK) -> DataFrame:
    """The complement in [0, size) of each key that has a range at all."""
    whole = runs.select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("s"), F.lit(size).cast("bigint").alias("e"))
    inside = join_ranges(runs, keys, block).select(*keys, F.greatest("s", F.lit(0)).alias("s"), F.least("e", F.lit(size)).alias("e")).filter("s < e")
    by = [*keys, "block"]
    steps = cut_at_edges(whole, keys, block).select(*by, "s", "e", F.lit(True).alias("frame")).unionByName(cut_at_edges(inside, keys, block).withColumn("frame", F.lit(False)))
    # in a block: what the frame covers before, between and after its ranges
    order = W.partitionBy(*by).orderBy(F.desc("frame"), "s")
    prior = steps.withColumn("_from", F.when(F.lag("frame").over(order), F.lag("s").over(order)).otherwise(F.lag("e").over(order)))
    prior = prior.withColumn("_end", F.max("e").over(W.partitionBy(*by))).withColumn("_last", F.lead("s").over(order).isNull())
    before = F.when(~F.col("frame"), F.struct(F.col("_from").alias("s"), F.col("s").alias("e")))
    after = F.when(F.col("_last"), F.struct(F.when(F.col("frame"), F.col("s")).otherwise(F.col("e")).alias("s"), F.col("_end").alias("e")))
    holes = prior.select(*by, F.explode(F.array(before, after)).alias("x")).select(*by, "x.s", "x.e")
    return _over_edges(holes.filter("s < e"), keys, block)


def overlaps(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], on: Column | None = None, equal: list[tuple[str, str]] | None = None, bucket: int | tuple[int, ...] = BUCKET) -> DataFrame:
    """Pairs of ranges that meet, with the common length ``inter``: a bucketed interval join.

    Both sides go into the buckets they touch; a pair is kept in the bucket of its common start only. With several bucket
    widths, ascending, a range goes into the buckets of the first width of which it takes at most SPREAD (else the last) and of all wider
    ones, and a pair is found at the greater of its two ranges' own widths: so a long range is a few rows, not one for each narrow bucket. ``equal`` are
    pairs of key columns that must be equal; ``on`` is a further condition. The key names of both sides must differ.
    """
    widths = (bucket,) if isinstance(bucket, int) else tuple(bucket)

    def placed(runs: DataFrame, keys: list[str], n: str) -> DataFrame:
        s, e, own, level = f"_s{n}", f"_e{n}", f"_o{n}", f"_w{n}"
        out = _real(runs, keys).select(*keys, F.col("s").alias(s), F.col("e").alias(e))
        if len(widths) == 1:
            return out.withColumn(f"_k{n}", F.explode(F.sequence(block_of(F.col(s), widths[0]), block_of(F.col(e) - 1, widths[0]))))
        fits = [F.when(F.col(e) - F.col(s) <= SPREAD * w, F.lit(i)) for i, w in enumerate(widths[:-1])]
        out = out.withColumn(own, F.coalesce(*fits, F.lit(len(widths) - 1)))
        at = lambda i: lambda k: F.struct(F.lit(i).alias("w"), k.alias("k"))
        spans = [F.when(F.col(own) <= i, F.transform(F.sequence(block_of(F.col(s), w), block_of(F.col(e) - 1, w)), at(i))) for i, w in enumerate(widths)]
        out = out.withColumn("_x", F.explode(F.flatten(F.array_compact(F.array(*spans)))))
        return out.select(*keys, s, e, own, F.col("_x.w").alias(level), F.col("_x.k").alias(f"_k{n}"))

    left, right = placed(a, a_keys, "1"), placed(b, b_keys, "2")
    cond = (F.col("_k1") == F.col("_k2")) & (F.col("_s1") < F.col("_e2")) & (F.col("_s2") < F.col("_e1"))
    start = F.greatest("_s1", "_s2")
    home = block_of(start, widths[0])
    if len(widths) > 1:
        cond = cond & (F.col("_w1") == F.col("_w2")) & (F.col("_w1") == F.greatest("_o1", "_o2"))
        home = F.coalesce(*[F.when(F.col("_w1") == i, block_of(start, w)) for i, w in enumerate(widths)])
    for x, y in equal or []:
        cond = cond & (F.col(x) == F.col(y))
    cond = cond & on if on is not None else cond
    met = left.join(right, cond).filter(F.col("_k1") == home)
    return met.select(*a_keys, *b_keys, start.alias("s"), F.least("_e1", "_e2").alias("e"), (F.least("_e1", "_e2") - start).alias("inter"))


def areas(runs: DataFrame, keys: list[str], name: str = "area") -> DataFrame:
    return _real(runs, keys).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias(name))


def pair_overlaps(a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], on: Column | None = None, equal: list[tuple[str, str]] | None = None, bucket: int | tuple[int, ...] = BUCKET) -> DataFrame:
    """(a_keys, b_keys, inter, iou, ioa): of objects that share an index; ioa is the share of b's object. Objects' ranges are disjoint."""
    inter = overlaps(a, a_keys, b, b_keys, on, equal, bucket).groupBy(*a_keys, *b_keys).agg(F.sum("inter").alias("inter"))
    na, nb = areas(a, a_keys, "_na"), areas(b, b_keys, "_nb")
    out = inter.join(na, a_keys).join(nb, b_keys)
    return out.select(*a_keys, *b_keys, "inter", (F.col("inter") / (F.col("_na") + F.col("_nb") - F.col("inter")).cast("double")).alias("iou"), (F.col("inter") / F.col("_nb").cast("double")).alias("ioa"))


def fill(runs: DataFrame, order: list[str], label: str, index: str = "idx") -> DataFrame:
    """Paints ranges on a dense line: (idx, label), the last one in ``order`` wins where they overlap (ties: the greatest label)."""
    painted = runs.filter("s < e").select(*order, label, F.explode(F.sequence("s", F.col("e") - 1)).alias(index))
    return painted.groupBy(index).agg(F.max(F.struct(*order, label)).alias("_x")).select(index, F.col(f"_x.{label}").alias(label))
