"""Continuous periods and gaps per entity from overlapping, nested and gapped intervals.

Each entity has an ordered map of disjoint intervals as keyed state. Rows are shuffled by key and sorted, so a task
holds the state of one key at a time; the same map serves the streaming operator in ``spanlattice.streaming``.
Entities with very many intervals are sorted together by entity and start over as many range partitions as their intervals fill, so
such an entity is cut into blocks of starts, each with a state of its own; the blocks' last ends are then carried
forward over the (few) blocks with a window. No task holds such an entity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlattice.session import Scratch

#: Intervals of an entity beyond which it is cut into blocks, and intervals of a block.
HOT_INTERVALS = 50_000
BLOCK_INTERVALS = 200_000


class IntervalMap:
    """Ordered disjoint half-open intervals, with the gaps between them; touching intervals are one."""

    __slots__ = ("starts", "ends", "gaps")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = starts or [], ends or []
        self.gaps = dict(zip(self.ends, self.starts[1:]))

    def insert(self, s: int, e: int) -> None:
        """Binary search for what [s, e) overlaps or touches; replace it by the union, and update the gaps around it."""
        i = bisect_left(self.ends, s)
        j = bisect_right(self.starts, e)
        for k in range(max(i - 1, 0), min(j, len(self.ends) - 1)):
            del self.gaps[self.ends[k]]
        if i < j:
            s, e = min(s, self.starts[i]), max(e, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [s], [e]
        if i:
            self.gaps[self.ends[i - 1]] = s
        if i + 1 < len(self.starts):
            self.gaps[e] = self.starts[i + 1]


def clean_intervals(starts: str, runs: str) -> Column:
    """array<struct<s,e>> of the usable pairs of two parallel arrays: both elements there and the run at least 1.

    Null arrays give an empty array; elements beyond the shorter array are unusable; so are runs ending beyond 2^63-1.
    """
    zipped = F.arrays_zip(F.coalesce(F.col(starts), F.array().cast("array<bigint>")).alias("s"), F.coalesce(F.col(runs), F.array().cast("array<bigint>")).alias("r"))
    usable = F.filter(zipped, lambda x: x["s"].isNotNull() & (x["r"] >= 1) & F.try_add(x["s"], x["r"]).isNotNull())
    return F.transform(usable, lambda x: F.struct(x["s"].alias("s"), F.try_add(x["s"], x["r"]).alias("e")))


def _states(batches: Iterator[pa.RecordBatch], gaps: bool) -> Iterator[pa.RecordBatch]:
    """Rows (entity, block, s array, e array), sorted by entity and block, to rows (entity, block, kind, s, e)."""
    out: list[list] = [[], [], [], [], []]
    key, state = None, None

    def flush() -> None:
        n, spans = len(state.starts), sorted(state.gaps.items()) if gaps else []
        out[0] += [key[0]] * (n + len(spans))
        out[1] += [key[1]] * (n + len(spans))
        out[2] += ["period"] * n + ["gap"] * len(spans)
        out[3] += state.starts + [a for a, _ in spans]
        out[4] += state.ends + [b for _, b in spans]

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["entity", "block", "kind", "s", "e"])
        for c in out:
            c.clear()
        return made

    for b in batches:
        ids, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
        ss, es = b.column(2), b.column(3)
        s_all, e_all, off = ss.values.to_pylist(), es.values.to_pylist(), ss.offsets.to_pylist()
        off_e = es.offsets.to_pylist()
        for i, now in enumerate(zip(ids, blocks)):
            if now != key:
                if state is not None:
                    flush()
                    if len(out[0]) > 50_000:
                        yield batch()
                key, state = now, IntervalMap()
            for s, e in zip(s_all[off[i] : off[i + 1]], e_all[off_e[i] : off_e[i + 1]]):
                state.insert(s, e)
    if state is not None:
        flush()
    if out[0]:
        yield batch()


def _run_states(ordered: DataFrame, gaps: bool) -> DataFrame:
    """``ordered`` has all rows of an entity's block in one partition, sorted by entity, block and s."""
    return ordered.mapInArrow(lambda it: _states(it, gaps), "entity bigint, block int, kind string, s bigint, e bigint")


def periods_and_gaps(df: DataFrame, entity: str, starts: str = "starts", runs: str = "runs", hot_intervals: int = HOT_INTERVALS, block_intervals: int = BLOCK_INTERVALS) -> DataFrame:
    """Rows (entity, span_kind, first_idx, end_idx), half-open, of all rows of an entity together.

    ``starts`` and ``runs`` are parallel bigint arrays. A ``period`` is a longest stretch covered without
    interruption, a ``gap`` the stretch between two successive periods. Rows with a null entity are left out, and so are
    unusable elements (see clean_intervals); entities without a usable interval and empty tables give no row;
    repeated rows change nothing.
    """
    rows = df.filter(F.col(entity).isNotNull()).select(F.col(entity).cast("bigint").alias("entity"), clean_intervals(starts, runs).alias("iv")).filter(F.size("iv") > 0)
    sizes = rows.groupBy("entity").agg(F.sum(F.size("iv")).alias("n")).filter(F.col("n") > hot_intervals)
    total = sizes.agg(F.sum("n")).first()[0]  # over hot entities
    whole = lambda part: _run_states(part.select("entity", F.lit(0).alias("block"), F.col("iv.s").alias("s"), F.col("iv.e").alias("e")).repartition("entity").sortWithinPartitions("entity", "block", "s"), True)
    if not total:
        return _spans(whole(rows), entity)
    scratch = Scratch(df.sparkSession, "periods")
    hot = scratch.keep(sizes.select("entity"))
    each = rows.join(hot, "entity", "left_semi").select("entity", F.explode("iv").alias("i"))
    pieces = scratch.keep(each.select("entity", F.col("i.s").alias("s"), F.col("i.e").alias("e")).groupBy("entity", "s").agg(F.max("e").alias("e")))
    spread = pieces.repartitionByRange(-(-total // block_intervals), "entity", "s").withColumn("block", F.spark_partition_id())
    blocks = _run_states(spread.select("entity", "block", F.array("s").alias("s"), F.array("e").alias("e")).sortWithinPartitions("entity", "block", "s"), False)
    return scratch.handed(_spans(whole(rows.join(hot, "entity", "left_anti")), entity).unionByName(_spans(_stitch(scratch.keep(blocks)), entity)))


def _spans(rows: DataFrame, entity: str) -> DataFrame:
    return rows.select(F.col("entity").alias(entity), F.col("kind").alias("span_kind"), F.col("s").alias("first_idx"), F.col("e").alias("end_idx"))


def _stitch(parts: DataFrame) -> DataFrame:
    """Joins the periods of an entity's blocks: block b's starts all lie before those of block b + 1."""
    blocks = W.partitionBy("entity").orderBy("block")
    carry = parts.groupBy("entity", "block").agg(F.max("e").alias("last")).withColumn("carry", F.max("last").over(blocks.rowsBetween(W.unboundedPreceding, -1))).select("entity", "block", "carry")
    seen = parts.join(carry, ["entity", "block"]).withColumn("live", F.coalesce(F.col("s") > F.col("carry"), F.lit(True)))
    per = seen.groupBy("entity", "block").agg(F.max(F.when(~F.col("live"), F.col("e"))).alias("absorbed"), F.max(F.when(F.col("live"), F.col("e"))).alias("live_end"), F.first("carry").alias("c"))
    per = per.withColumn("at", F.greatest("absorbed", "c")).withColumn("has", F.col("live_end").isNotNull().cast("int"))
    per = per.withColumn("seg", F.sum("has").over(blocks.rowsBetween(W.unboundedPreceding, 0)))
    own = per.filter("has = 1").select("entity", "seg", F.col("live_end").alias("x"))
    later = per.withColumn("seg", F.col("seg") - F.col("has")).select("entity", "seg", F.col("absorbed").alias("x"))
    ends = own.unionByName(later).groupBy("entity", "seg").agg(F.max("x").alias("close"))
    closing = per.filter("has = 1").join(ends, ["entity", "seg"]).select("entity", "block", "live_end", "close", "at")
    inside = W.partitionBy("entity", "block").orderBy("s")
    live = seen.filter("live").join(closing, ["entity", "block"])
    live = live.withColumn("before", F.coalesce(F.lag("e").over(inside), "at")).withColumn("end", F.when(F.col("e") == F.col("live_end"), F.col("close")).otherwise(F.col("e")))
    spans = F.explode(F.array(F.struct(F.lit("period").alias("kind"), F.col("s"), F.col("end").alias("e")), F.struct(F.lit("gap").alias("kind"), F.col("before").alias("s"), F.col("s").alias("e"))))
    return live.select("entity", "block", spans.alias("x")).filter("x.s is not null").select("entity", "block", "x.kind", "x.s", "x.e")
