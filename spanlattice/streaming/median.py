"""Median filter across the slices of a stack."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class MedianQueue:
    """The last slices of one pixel. A median is written back, so later medians see filtered values.

    The first size // 2 values come out raw at once, then one value lags behind; ``end`` gives what is left, raw.
    A value is (key, number); no value is ever lost, also of stacks shorter than the window.
    """

    def __init__(self, size: int, held: list | None = None, seen: int = 0):
        if size % 2 == 0:
            raise ValueError("the window must be odd")
        self.size, self.held, self.seen = size, deque(held or []), seen

    def push(self, key, value: float) -> list[tuple]:
        mid = self.size // 2
        self.held.append([key, value])
        self.seen += 1
        out = [tuple(self.held[-1])] if self.seen <= mid else []
        if len(self.held) == self.size:
            middle = self.held[mid]
            middle[1] = float(np.median([v for _, v in self.held]))
            out.append(tuple(middle))
            self.held.popleft()
        return out

    def end(self) -> list[tuple]:
        mid = self.size // 2
        waiting = list(self.held)
        emitted = min(self.seen, mid) if self.seen < self.size else len(waiting) - mid
        return [tuple(x) for x in waiting[emitted:]]


def sliding_median(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, name: str = "median") -> DataFrame:
    """Adds the median of the centred window of ``size`` raw values; raw where the window leaves the stack."""
    half = size // 2
    w = W.partitionBy(*keys).orderBy(*order)
    full = F.count(F.lit(1)).over(w.rowsBetween(-half, half)) == size
    return df.withColumn(name, F.when(full, F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-half, half))).otherwise(F.col(value).cast("double")))


def recursive_median(df: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """(keys, order, median) by MedianQueue. Each key's rows are read in order; only the window is held in memory.

    Rows with a null value pass as they are and do not enter the window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, queue = None, None
        n = len(keys)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                now, at, v = row[:n], row[n:-1], row[-1]
                if now != key:
                    out.extend((*key, *k, m) for k, m in (queue.end() if queue else []))
                    key, queue = now, MedianQueue(size)
                if pd.isna(v):
                    out.append((*now, *at, None))
                else:
                    out.extend((*key, *k, m) for k, m in queue.push(at, float(v)))
            yield pd.DataFrame(out, columns=[*keys, *order, "median"])
        if queue:
            yield pd.DataFrame([(*key, *k, m) for k, m in queue.end()], columns=[*keys, *order, "median"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, *order]) + ", median double"
    return df.select(*keys, *order, value).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _filtered(value: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """What MedianQueue makes of the values of each group, whose rows are together and in order; all groups take a step at a time."""
    value, mid = value.copy(), size // 2
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(group)])
    for at in range(mid, n.max(initial=0) - mid):
        i = first[n > at + mid] + at
        value[i] = np.median(value[i[:, None] + np.arange(-mid, mid + 1)], axis=1)
    return value


def recursive_median_array(df: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """The rows with ``value``, an array of doubles, filtered by recursive_median, each element (channel) by itself; other columns stay as they are.

    One exchange of the rows and no join; a task holds one key's rows at a time beyond a batch. Null and NaN elements come out null and do not enter the window.
    """

    def smooth(rows: pa.Table, group: np.ndarray) -> pa.Table:
        lists = rows[value].combine_chunks()
        flat, n = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()
        ends = np.cumsum(n)
        channel, group = np.arange(len(flat)) - np.repeat(ends - n, n), np.repeat(group, n)
        v = flat.to_numpy(zero_copy_only=False).astype(float)
        for c in range(n.max(initial=0)):
            i = np.flatnonzero((channel == c) & ~np.isnan(v))
            v[i] = _filtered(v[i], group[i], size)
        made = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(v, from_pandas=True), type=lists.type)
        return rows.set_column(rows.schema.get_field_index(value), rows.schema.field(value), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            new = starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows]) if held else rows)
            new = new[1:] if held else new
            at = np.flatnonzero(new)  # keys that begin here
            if not len(at) or held == [] and len(at) == 1:
                held.append(rows)
                continue
            whole = pa.concat_tables([*held, rows.slice(0, at[-1])])
            held = [rows.slice(at[-1])]
            yield from smooth(whole, np.cumsum(starts(whole))).to_batches()
        if held:
            whole = pa.concat_tables(held)
            yield from smooth(whole, np.cumsum(starts(whole))).to_batches()

    def starts(rows: pa.Table) -> np.ndarray:
        """Whether each row's key is another than that of the row before."""
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            c = rows[k].combine_chunks()
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            new[1:] |= ~same.to_numpy(zero_copy_only=False)
        return new

    df = df.withColumn(value, F.col(value).cast("array<double>"))
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, df.schema)


class MedianProcessor(StatefulProcessor):
    """MedianQueue as streaming state: rows (key, slice bigint, value double, last boolean) that arrive in slice order; ``last`` ends the stack.

    Slices that arrive early wait in the state until the gap closes.
    """

    def __init__(self, size: int = 3):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getValueState("queue", "slices array<bigint>, numbers array<double>, seen bigint")
        self.early = handle.getMapState("early", "slice bigint", "value double, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slices, numbers, seen = self.queue.get() if self.queue.exists() else ([], [], 0)
        q = MedianQueue(self.size, [[a, b] for a, b in zip(slices, numbers)], seen)
        for pdf in rows:
            for z, v, last in zip(pdf["slice"], pdf["value"], pdf["last"]):
                self.early.updateValue((int(z),), (float(v), bool(last)))
        out, ended = [], False
        while not ended and self.early.containsKey((q.seen,)):
            z = q.seen
            v, last = self.early.getValue((z,))
            self.early.removeKey((z,))
            out += q.push(z, v)
            ended = last
        if ended:
            out += q.end()
            self.queue.clear()
        else:
            self.queue.update(([x for x, _ in q.held], [float(x) for _, x in q.held], q.seen))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "slice": [z for z, _ in out], "median": [m for _, m in out]})

    def close(self) -> None:
        pass


def median_stream(rows: DataFrame, size: int = 3) -> DataFrame:
    """(key, slice, median) of a stream (key string, slice from 0, value, last). Needs the RocksDB state store."""
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=MedianProcessor(size), outputStructType="key string, slice bigint, median double", outputMode="Append", timeMode="None")
