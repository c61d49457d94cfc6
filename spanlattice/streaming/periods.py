"""Periods and gaps per entity over a stream of intervals, kept as an ordered disjoint-interval map in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanlattice.operators.periods import IntervalMap, clean_intervals


class PeriodProcessor(StatefulProcessor):
    """The state is the entity's map; each batch that touches an entity gives all its periods and gaps anew (update mode).

    An entity's map has to fit into a task; the batch operator cuts larger ones.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.map = handle.getValueState("map", "starts array<bigint>, ends array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m = IntervalMap(*map(list, self.map.get())) if self.map.exists() else IntervalMap()
        for pdf in rows:
            for s, e in zip(pdf["s"], pdf["e"]):
                m.insert(int(s), int(e))
        self.map.update((m.starts, m.ends))
        gaps = sorted(m.gaps.items())
        first, end = m.starts + [a for a, _ in gaps], m.ends + [b for _, b in gaps]
        kinds = ["period"] * len(m.starts) + ["gap"] * len(gaps)
        yield pd.DataFrame({"entity": [key[0]] * len(first), "span_kind": kinds, "first_idx": first, "end_idx": end})

    def close(self) -> None:
        pass


def period_stream(rows: DataFrame, entity: str, starts: str = "starts", runs: str = "runs") -> DataFrame:
    """(entity, span_kind, first_idx, end_idx) in update mode. Unusable elements are left out as in periods_and_gaps. Needs the RocksDB state store."""
    iv = rows.filter(F.col(entity).isNotNull()).select(F.col(entity).cast("bigint").alias("entity"), F.explode(clean_intervals(starts, runs)).alias("i"))
    flat = iv.select("entity", F.col("i.s").alias("s"), F.col("i.e").alias("e"))
    return flat.groupBy("entity").transformWithStateInPandas(statefulProcessor=PeriodProcessor(), outputStructType="entity bigint, span_kind string, first_idx bigint, end_idx bigint", outputMode="Update", timeMode="None")
