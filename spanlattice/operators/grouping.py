"""Python on one small group of rows after the other, many groups in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows given back at once.
ROWS = 50_000


def by_key(df: DataFrame, key: str, f: Callable[[list[tuple]], list[tuple]], schema: StructType | str, large: Callable[[pa.Table], Iterator[pa.RecordBatch]] | None = None, most: int = ROWS) -> DataFrame:
    """The rows of ``f`` of each group of equal ``key`` (the first column); a group is a list of row tuples, in no order.

    Rows are shuffled and sorted by the key and read one group at a time, without a data frame for each group. With ``large``, a group of
    ``most`` rows or more is held as columns and given to it instead; it gives back batches of the result's columns.
    """
    df = df.select(key, *[c for c in df.columns if c != key])
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, given = to_arrow_schema(schema), to_arrow_schema(df.schema)

    def packed(rows: list[tuple], to: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in to]
        made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, to)], schema=to)
        rows.clear()
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, now, out = [], [], None, []

        def ended() -> Iterator[pa.RecordBatch]:
            if parts:
                table = pa.Table.from_batches([*parts, packed(group, given)])
                parts.clear()
                yield from (b.cast(arrow) for b in large(table))
            elif group:
                out.extend(f(group))
            if len(out) >= ROWS:
                yield packed(out, arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != now:
                    yield from ended()
                    group = []
                now = row[0]
                group.append(row)
                if large is not None and len(group) >= most:
                    parts.append(packed(group, given))
        yield from ended()
        yield packed(out, arrow)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
