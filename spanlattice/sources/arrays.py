"""Arrays in foreign formats on any file system: chunked array folders (versions 2 and 3 of the format, nested names included) and image and volume files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from spanlattice.sources.formats import CODECS, array_of

AXES = ("cz", "cy", "cx")
#: Chunks that one task reads, at most.
CHUNKS_PER_TASK = 64


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or address (local, HDFS, object stores), and the path in it."""
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


def read_file(fs: FileSystem, path: str) -> bytes | None:
    """None if there is no such file."""
    try:
        with fs.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


class Wanted:
    """Which block numbers the pushed filters on cz, cy and cx leave; Spark applies the filters again."""

    def __init__(self):
        self.least, self.most, self.among = dict.fromkeys(AXES, 0), dict.fromkeys(AXES, float("inf")), {}

    def learn(self, f: Filter) -> None:
        axis = getattr(f, "attribute", (None,))[0]
        if axis not in AXES:
            return
        if isinstance(f, (EqualTo, In)):
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.among[axis] = values & self.among.get(axis, values)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least[axis] = max(self.least[axis], f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.most[axis] = min(self.most[axis], f.value - isinstance(f, LessThan))

    def has(self, at: tuple[int, ...]) -> bool:
        return all(self.least[a] <= n <= self.most[a] and n in self.among.get(a, (n,)) for a, n in zip(AXES, at))


class _Layout:
    """What the array's description says, for either version: shape, chunks, type, codecs, names of chunks."""

    def __init__(self, fs: FileSystem, folder: str):
        old, new = read_file(fs, f"{folder}/.zarray"), read_file(fs, f"{folder}/zarr.json")
        if old is None and new is None:
            raise ValueError(f"{folder} holds no array")
        m = json.loads(old if old is not None else new)
        self.shape, self.prefix, self.transpose = m["shape"], "", None
        if old is not None:
            self.chunks, self.dtype, self.order = m["chunks"], np.dtype(m["dtype"]), m.get("order", "C")
            self.codecs, self.separator = [(m.get("compressor") or {}).get("id")], m.get("dimension_separator", ".")
            if m.get("filters"):
                raise ValueError("filters are not supported")
        else:
            self.chunks, self.order = m["chunk_grid"]["configuration"]["chunk_shape"], "C"
            keys = m.get("chunk_key_encoding", {"name": "default"})
            self.separator = keys.get("configuration", {}).get("separator", "/" if keys["name"] == "default" else ".")
            self.prefix = "c" + self.separator if keys["name"] == "default" else ""
            names, endian = [], "<"
            for c in m["codecs"]:
                how = c.get("configuration", {})
                if c["name"] == "bytes":
                    endian = ">" if how.get("endian") == "big" else "<"
                elif c["name"] == "transpose":
                    self.transpose = how["order"]
                else:
                    names.append(c["name"])
            self.codecs, self.dtype = names[::-1], np.dtype(m["data_type"]).newbyteorder(endian)
        if not 2 <= len(self.shape) <= 3:
            raise ValueError("only arrays of two or three dimensions are read")
        if missing := [c for c in self.codecs if c not in CODECS]:
            raise ValueError(f"compressor {missing[0]!r} is not supported")
        self.fill = m.get("fill_value") or 0
        self.flat = len(self.shape) == 2

    def at(self, name: str) -> tuple[int, int, int] | None:
        """Block numbers of a chunk's name below the folder; None for other files."""
        parts = name[len(self.prefix) :].split(self.separator) if name.startswith(self.prefix) else []
        if len(parts) != len(self.shape) or not all(p.isdigit() for p in parts):
            return None
        return (0,) * self.flat + tuple(map(int, parts))

    def block(self, raw: bytes, at: tuple[int, int, int]) -> np.ndarray:
        for c in self.codecs:
            raw = CODECS[c](raw)
        chunks = self.chunks if self.transpose is None else [self.chunks[k] for k in self.transpose]
        block = np.frombuffer(raw, self.dtype).reshape(chunks, order=self.order)
        block = block if self.transpose is None else block.transpose(np.argsort(self.transpose))
        at, shape, sizes = (at[1:], self.shape, self.chunks) if self.flat else (at, self.shape, self.chunks)
        block = block[tuple(slice(0, min(c, s - a * c)) for a, c, s in zip(at, sizes, shape))]  # chunks at the edges are stored whole
        return block[None] if self.flat else block


class _Chunks(InputPartition):
    def __init__(self, found: list[tuple[tuple[int, int, int], str]]):
        self.found = found


class _ChunkReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder, Wanted()
        self.layout = _Layout(*file_system(folder))

    def pushFilters(self, filters):
        for f in filters:
            self.wanted.learn(f)
            yield f

    def partitions(self):
        fs, root = file_system(self.folder)
        found = []
        for info in fs.get_file_info(FileSelector(root, recursive=self.layout.separator == "/")):  # a listing, not a question for each chunk
            at = self.layout.at(info.path[len(root.rstrip("/")) + 1 :]) if info.type == FileType.File else None
            if at is not None and self.wanted.has(at):
                found.append((at, info.path))
        found.sort()
        return [_Chunks(found[k : k + CHUNKS_PER_TASK]) for k in range(0, len(found), CHUNKS_PER_TASK)]

    def read(self, partition: _Chunks) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.folder)
        sizes = [1] * self.layout.flat + list(self.layout.chunks)
        for at, path in partition.found:
            raw = read_file(fs, path)
            if raw is None:
                continue
            block = self.layout.block(raw, at)
            z, y, x = np.nonzero(block != self.layout.fill)
            cols = [np.full(len(z), a, np.int32) for a in at] + [(v + a * c).astype(np.int32) for v, a, c in zip((z, y, x), at, sizes)] + [block[z, y, x].astype(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*AXES, "z", "y", "x", "value"])


class ChunkedArray(DataSource):
    """spark.read.format("chunked").option("key", "em/raw").load(folder): one row for each voxel that is not the fill value; absent chunks are all of it."""

    @classmethod
    def name(cls):
        return "chunked"

    def schema(self):
        return "cz int, cy int, cx int, z int, y int, x int, value double"

    def reader(self, schema):
        return _ChunkReader("/".join([self.options["path"].rstrip("/"), *[k for k in self.options.get("key", "").split("/") if k]]))


def read_chunked(spark: SparkSession, path: str) -> DataFrame:
    """``path`` is a folder, or a folder and the array's nested name in it after a comma; filters on cz, cy, cx (=, <, >, in) prune chunks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedArray)
    folder, _, key = path.partition(",")
    return spark.read.format("chunked").option("key", key).load(folder)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, y, x, value) of the pixels that are not 0 of TIFF, PNG, MRC, NRRD and NIfTI files; a file that cannot be read is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                for k, page in enumerate(array_of(data, name)):
                    y, x = np.nonzero(page)
                    yield pd.DataFrame({"path": name, "z": np.full(len(y), k, np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "value": page[y, x].astype(np.float64)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, z int, y int, x int, value double")


def normalised(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Values scaled to 0..255 by the greatest of their key, cut to whole numbers; 0 where that is 0."""
    top = values.groupBy(*keys).agg(F.max(value).alias("_m"))
    scaled = F.when(F.col("_m") > 0, F.col(value) / F.col("_m") * 255).otherwise(0.0)
    return values.join(top, keys).withColumn(value, scaled.cast("int")).drop("_m")


def smallest_type(greatest: int) -> str:
    """Name of the narrowest unsigned type that holds labels up to ``greatest``."""
    return next(f"uint{b}" for b in (8, 16, 32, 64) if greatest < 2**b)
