"""Forward matching of slice objects as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanlattice.operators.track import Matcher


class MatchProcessor(StatefulProcessor):
    """Rows (stack, slice, label, starts, runs), a null label marking a slice without objects, and ``complete`` its last row.

    The state is the matcher (last slice and next label), the number of the next slice, and the slices that came early. A slice is matched
    once its complete row is there and all before it are done.
    """

    def __init__(self, first_label: int, iou: float, ioa: float):
        self.first_label, self.iou, self.ioa = first_label, iou, ioa

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next_slice bigint, next_label bigint, target string")
        self.waiting = handle.getMapState("waiting", "slice bigint", "objects string, complete boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, label, target = self.state.get() if self.state.exists() else (0, self.first_label, None)
        m = Matcher(self.first_label, self.iou, self.ioa)
        m.next, m.target = label, None if target is None else {int(k): [tuple(x) for x in v] for k, v in json.loads(target).items()}
        for pdf in rows:
            for z, x, starts, runs, complete in zip(pdf["slice"], pdf["label"], pdf["starts"], pdf["runs"], pdf["complete"]):
                held, done = self.waiting.getValue((int(z),)) if self.waiting.containsKey((int(z),)) else ("{}", False)
                objects = json.loads(held)
                if pd.notna(x):
                    objects.setdefault(str(int(x)), []).extend((int(s), int(s) + int(r)) for s, r in zip(starts, runs))
                self.waiting.updateValue((int(z),), (json.dumps(objects), bool(done or complete)))
        out = []
        while self.waiting.containsKey((at,)) and self.waiting.getValue((at,))[1]:
            objects = {int(k): [tuple(x) for x in v] for k, v in json.loads(self.waiting.getValue((at,))[0]).items()}
            self.waiting.removeKey((at,))
            out += [(key[0], at, x, y) for x, y in m.step(objects).items()]
            at += 1
        self.state.update((at, m.next, None if m.target is None else json.dumps(m.target)))
        if out:
            yield pd.DataFrame(out, columns=["stack", "slice", "label", "new_label"])

    def close(self) -> None:
        pass


def match_stream(rows: DataFrame, first_label: int, iou: float = 0.25, ioa: float = 0.25) -> DataFrame:
    """(stack, slice, label, new_label) of a stream of slices, numbered from 0. Needs the RocksDB state store."""
    return rows.groupBy("stack").transformWithStateInPandas(statefulProcessor=MatchProcessor(first_label, iou, ioa), outputStructType="stack string, slice bigint, label bigint, new_label bigint", outputMode="Append", timeMode="None")
