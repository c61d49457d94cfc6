"""Run-length arrays (starts, runs) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranges(starts: Column, runs: Column) -> Column:
    """array<struct<s, e>> of parallel arrays; pairs with a null element or a run below 1 are left out, null arrays give none."""
    none = F.array().cast("array<bigint>")
    zipped = F.arrays_zip(F.coalesce(starts, none).alias("s"), F.coalesce(runs, none).alias("r"))
    return F.transform(F.filter(zipped, lambda x: x["s"].isNotNull() & (x["r"] >= 1)), lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["r"]).alias("e")))


def range_starts(of: Column) -> Column:
    return F.transform(of, lambda x: x["s"])


def range_lengths(of: Column) -> Column:
    return F.transform(of, lambda x: x["e"] - x["s"])


def to_text(starts: Column, runs: Column) -> Column:
    """'s r s r ...'; null if an array is null."""
    return F.array_join(F.flatten(F.zip_with(starts, runs, lambda s, r: F.array(s.cast("string"), r.cast("string")))), " ")


def text_starts(text: Column) -> Column:
    """The numbers at even places of a text made by to_text; the empty text has none."""
    return _every_second(text, 0)


def text_runs(text: Column) -> Column:
    return _every_second(text, 1)


def _every_second(text: Column, which: int) -> Column:
    parts = F.filter(F.split(F.trim(text), "\\s+"), lambda x: x != "")
    return F.transform(F.filter(parts, lambda x, i: i % 2 == which), lambda x: x.cast("bigint"))


def decode(starts: Column, runs: Column) -> Column:
    """All indices, in the order of the arrays."""
    spans = F.filter(ranges(starts, runs), lambda x: x["s"] < x["e"])
    return F.flatten(F.transform(spans, lambda x: F.sequence(x["s"], x["e"] - 1)))


def ravel(z: Column, y: Column, x: Column, h: int | Column, w: int | Column) -> Column:
    """C-order index in a volume whose slices are h x w."""
    h, w = (v if isinstance(v, Column) else F.lit(v).cast("bigint") for v in (h, w))
    return (z * h + y) * w + x


def unravel(index: Column, h: int | Column, w: int | Column) -> Column:
    """struct(z, y, x) of a C-order index, rounded towards lower slices."""
    h, w = (v if isinstance(v, Column) else F.lit(v).cast("bigint") for v in (h, w))
    x = F.pmod(index, w)
    row = F.call_function("div", index - x, w)
    y = F.pmod(row, h)
    return F.struct(F.call_function("div", row - y, h).alias("z"), y.alias("y"), x.alias("x"))
