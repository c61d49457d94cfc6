"""Volumes: a data source for folders of raw blocks, slices along an axis, and sinks that fill dense volumes.

A folder of blocks holds ``volume.json`` (shape, chunks, dtype) and a file ``z.y.x`` of raw C-order bytes for each block that is not all zero, at the
block's own place in the grid. The reader gives one partition for each block and prunes blocks by filters on cz, cy and cx.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanlattice.operators.runs import block_of, cut_at_edges
from spanlattice.sources.arrays import Wanted, file_system, read_file

SCHEMA = "cz int, cy int, cx int, z int, y int, x int, value bigint"


class _Block(InputPartition):
    def __init__(self, at: tuple[int, int, int]):
        self.at = at


class _BlockReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted = Wanted()

    def pushFilters(self, filters):
        for f in filters:
            self.wanted.learn(f)
            yield f

    def partitions(self):
        fs, root = file_system(self.path)
        names = sorted(info.base_name for info in fs.get_file_info(FileSelector(root)))
        found = [tuple(map(int, n.split("."))) for n in names if n.count(".") == 2 and n.replace(".", "").isdigit()]
        return [_Block(at) for at in found if self.wanted.has(at)]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.path)
        meta = json.loads(read_file(fs, f"{root}/volume.json"))
        at, chunks = partition.at, meta["chunks"]
        own = [min(c, s - a * c) for a, c, s in zip(at, chunks, meta["shape"])]
        block = np.frombuffer(read_file(fs, f"{root}/" + ".".join(map(str, at))), meta["dtype"]).reshape(own)
        z, y, x = np.nonzero(block)
        n = len(z)
        cols = [np.full(n, a, np.int32) for a in at] + [(v + a * c).astype(np.int32) for v, a, c in zip((z, y, x), at, chunks)] + [block[z, y, x].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cz", "cy", "cx", "z", "y", "x", "value"])


class BlockVolume(DataSource):
    """spark.read.format("blocks").load(folder): one row for each voxel that is not 0."""

    @classmethod
    def name(cls):
        return "blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _BlockReader(self.options["path"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockVolume)
    return spark.read.format("blocks").load(path)


def slices(voxels: DataFrame, axis: str, index: int | None = None) -> DataFrame:
    """Voxels as (slice, y, x, ...) across axis 'xy' (z), 'xz' (y) or 'yz' (x); one slice only with ``index``."""
    across, rows, cols = {"xy": ("z", "y", "x"), "xz": ("y", "z", "x"), "yz": ("x", "z", "y")}[axis]
    rest = [c for c in voxels.columns if c not in ("z", "y", "x")]
    kept = voxels if index is None else voxels.filter(F.col(across) == index)
    return kept.select(F.col(across).alias("slice"), F.col(rows).alias("y"), F.col(cols).alias("x"), *rest)


def put_slice(voxels: DataFrame, pixels: DataFrame, axis: str, index: int) -> DataFrame:
    """The volume with a slice replaced by ``pixels`` (y, x, value)."""
    across, rows, cols = {"xy": ("z", "y", "x"), "xz": ("y", "z", "x"), "yz": ("x", "z", "y")}[axis]
    names = {across: F.lit(index).cast("int"), rows: F.col("y").cast("int"), cols: F.col("x").cast("int")}
    new = pixels.select(*[names[c].alias(c) for c in ("z", "y", "x")], "value")
    return voxels.select("z", "y", "x", "value").filter(F.col(across) != index).unionByName(new)


def downsampled(pixels: DataFrame, factor: int) -> DataFrame:
    """Every factor-th row and column."""
    keep = (F.pmod("y", F.lit(factor)) == 0) & (F.pmod("x", F.lit(factor)) == 0)
    return pixels.filter(keep).withColumn("y", (F.col("y") / factor).cast("int")).withColumn("x", (F.col("x") / factor).cast("int"))


def quantised_sum(voxels: DataFrame, at: list[str], probability: str, n_stacks: int, name: str) -> DataFrame:
    """(at, name): probabilities of ``n_stacks`` stacks, each quantised to 255 // n_stacks steps, added up per place."""
    return voxels.groupBy(*at).agg(F.sum(F.floor(F.col(probability) * (255 // n_stacks)).cast("int")).alias(name))


#: Indices of a line that one task paints at once: two arrays of so many numbers.
PAINTED = 1 << 20


def fill_last_wins(runs: DataFrame, label: str, order: str, block: int = PAINTED) -> DataFrame:
    """(idx, label): ranges painted in ``order`` (ties: by label), where the last one wins; ``label`` is a whole number.

    Ranges, not their voxels, are shuffled, by block of the index space, and painted one over the other on the block's line.
    """
    cut = cut_at_edges(runs.select(order, F.col(label).cast("bigint").alias(label), "s", "e").filter(F.col(label).isNotNull()), [order, label], block)

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, there, now = np.zeros(block, np.int64), np.zeros(block, bool), None

        def painted() -> pa.RecordBatch:
            at = np.flatnonzero(there)
            out = pa.RecordBatch.from_arrays([pa.array(at + now * block), pa.array(line[at])], ["idx", label])
            there[:] = False
            return out

        for b in batches:
            for k, x, s, e in zip(*(b.column(j).to_pylist() for j in range(4))):
                if k != now:
                    if now is not None:
                        yield painted()
                    now = k
                line[s - k * block : e - k * block] = x
                there[s - k * block : e - k * block] = True
        if now is not None:
            yield painted()

    sorted_ = cut.repartition("block").sortWithinPartitions("block", order, label).select("block", label, "s", "e")
    return sorted_.mapInArrow(paint, f"idx bigint, `{label}` bigint")


def chunk_runs(runs: DataFrame, keys: list[str], shape: tuple[int, int, int], chunks: tuple[int, int, int]) -> DataFrame:
    """(keys, cz, cy, cx, s, e): ranges of a raveled volume cut where the chunk changes; s and e stay global."""
    d, h, w = shape
    rows = cut_at_edges(runs, keys, w, "row")
    z, y = block_of(F.col("row"), h), F.pmod("row", F.lit(h).cast("bigint"))
    x1, x2 = F.col("s") - F.col("row") * w, F.col("e") - F.col("row") * w
    at = rows.withColumn("cz", F.floor(z / chunks[0]).cast("int")).withColumn("cy", F.floor(y / chunks[1]).cast("int"))
    at = at.withColumn("cx", F.explode(F.sequence(F.floor(x1 / chunks[2]), F.floor((x2 - 1) / chunks[2]))))
    low = F.col("row") * w + F.col("cx") * chunks[2]
    return at.select(*keys, "cz", "cy", F.col("cx").cast("int").alias("cx"), F.greatest("s", low).alias("s"), F.least("e", low + chunks[2]).alias("e"))


def write_blocks(runs: DataFrame, label: str, order: str, path: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], dtype: str = "uint32") -> int:
    """Fills a folder of blocks from ranges; one task writes a block, so no two ever meet. Returns the number of blocks.

    ``path`` is a folder or address that all executors share; a block written again by a repeated task is the same. A block is bounded by ``chunks``.
    """
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/volume.json") as f:
        f.write(json.dumps({"shape": list(shape), "chunks": list(chunks), "dtype": dtype}).encode())
    d, h, w = shape

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [int(pdf[c].iloc[0]) for c in ("cz", "cy", "cx")]
        own = [min(c, s - a * c) for a, c, s in zip(at, chunks, shape)]
        block = np.zeros(own, dtype)
        for s, e, x in pdf.sort_values([order, label])[["s", "e", label]].itertuples(index=False, name=None):
            row, x0 = divmod(s, w)
            z, y = divmod(row, h)
            block[z - at[0] * chunks[0], y - at[1] * chunks[1], x0 - at[2] * chunks[2] : x0 - at[2] * chunks[2] + e - s] = x
        own_fs, folder = file_system(path)
        with own_fs.open_output_stream(f"{folder}/" + ".".join(map(str, at))) as f:
            f.write(block.tobytes())
        return pd.DataFrame({"n": [1]})

    cut = chunk_runs(runs, [order, label], shape, chunks)
    return cut.groupBy("cz", "cy", "cx").applyInPandas(fill, "n int").count()


def fill(runs: DataFrame, label: str, order: str, path: str, shape: tuple[int, int, int], chunks: tuple[int, int, int] | None = None, form: str = "blocks") -> None:
    """Writes the volume that the ranges paint: as ``blocks`` (see write_blocks; ``chunks`` bound what a task holds), or as ``parquet`` rows (idx, label)."""
    if form == "blocks":
        if chunks is None:
            raise ValueError("blocks need chunks")
        write_blocks(runs, label, order, path, shape, chunks)
    elif form == "parquet":
        fill_last_wins(runs, label, order).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"form {form!r} is neither 'blocks' nor 'parquet'")
