"""Tokens of many items, packed into a few rows for each shuffle bucket, for joins on tokens.

A row for each token would be some forty bytes and much work for the JVM. Here a task gathers the tokens of many items and sends one row for each
bucket of the token space: the items, how many tokens each has there, and four bytes for each token. Within a bucket of some
million tokens four bytes rarely coincide by chance; where they do, a candidate too many is verified.

A token that very many items share is split: by a count sketch of fixed size the expected length of its list is known to every
task, and a list beyond LIST is spread over cells of about LIST items each, so that no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tokens that a task gathers before it sends its rows, and tokens of a bucket.
FLUSH = 2_000_000
BUCKET = 2_000_000
#: Items of one token that meet in one cell.
LIST = 4_096
#: Counters of the sketch: a fixed number, however much data there is.
SKETCH_BITS = 20
#: Counters sent together.
BLOCK = 1 << 14

SCHEMA = "bucket int, owners binary, counts binary, metas binary, tokens binary, marks binary"
NAMES = ["bucket", "owners", "counts", "metas", "tokens", "marks"]


def mix(x: np.ndarray, order: int = 0) -> np.ndarray:
    """Bijective mixing of 64-bit numbers, another one for each order."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (order + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# the sketch


def slot(mixed: np.ndarray) -> np.ndarray:
    """The counter of each token, given by mixed (evenly spread) numbers."""
    return (mixed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch_rows(counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(block numbers, counters of the block as bytes) of the blocks that are not zero."""
    blocks = counts.astype(np.uint32).reshape(-1, BLOCK)
    at = np.flatnonzero(blocks.any(axis=1))
    return at, [blocks[i].tobytes() for i in at]


def gather_sketch(rows: DataFrame) -> np.ndarray:
    """The summed counters from rows (block int, counts binary); 2^SKETCH_BITS numbers, whatever the data."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << SKETCH_BITS, np.int64).reshape(-1, BLOCK)
    for r in rows.select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():  # 2^SKETCH_BITS / BLOCK rows
        out[r["block"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out.reshape(-1)


def cells_of_lists(sketch: np.ndarray, limit: int | None = None) -> np.ndarray:
    """For each counter, into how many cells the lists of its tokens are split: 1 for all but counters that stand out."""
    limit = LIST if limit is None else limit
    cells = np.ones(len(sketch), np.int64)
    hot = sketch > limit + 4 * int(sketch.mean())
    cells[hot] = -(-sketch[hot] // limit)
    return cells


def in_cells(tokens: np.ndarray, cells: np.ndarray, part: np.ndarray, both: bool, spread: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(which entry, its token in a cell) so that entries meet whose tokens are equal, however many cells these have.

    ``part`` is a number that scatters the items. A self join (``both``) has a cell for each two parts; in a join of two sides
    one side goes to the cell of its part and the other (``spread``) to all.
    """
    many = cells > 1
    if not many.any():
        return np.arange(len(tokens)), tokens
    which = [np.flatnonzero(~many)]
    out = [tokens[which[0]]]
    hot = np.flatnonzero(many)
    own = (part[hot].astype(np.uint64) % cells[hot].astype(np.uint64)).astype(np.int64)
    if both or spread:
        at = np.repeat(np.arange(len(hot)), cells[hot])
        other = np.arange(len(at)) - np.repeat(np.cumsum(cells[hot]) - cells[hot], cells[hot])
        a, b = (np.minimum(own[at], other), np.maximum(own[at], other)) if both else (other, other)
    else:
        at, a, b = np.arange(len(hot)), own, own
    which.append(hot[at])
    out.append(mix(tokens[hot[at]] ^ mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), 3), 4))
    return np.concatenate(which), np.concatenate(out)


# packing


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of an array up to each of ``ends``, as bytes."""
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def buckets_for(spark: SparkSession, n_tokens: int) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // BUCKET))


class Packer:
    """Gathers entries (item, its number ``meta``, token, mark 0..255) and gives them as rows of SCHEMA."""

    def __init__(self, buckets: int):
        self.buckets, self.n, self.parts = buckets, 0, []

    def add(self, owners: np.ndarray, metas: np.ndarray, which: np.ndarray, tokens: np.ndarray, marks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``which`` has for each token the place of its item in ``owners``."""
        if len(tokens):
            self.parts.append((owners, metas, which, tokens, np.zeros(len(tokens), np.uint8) if marks is None else marks))
            self.n += len(tokens)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        first = np.cumsum([0, *(len(p[0]) for p in self.parts)])[:-1]
        owners, metas = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]).astype(np.int32)
        which = np.concatenate([p[2] + k for p, k in zip(self.parts, first)])
        tokens, marks = np.concatenate([p[3] for p in self.parts]), np.concatenate([p[4] for p in self.parts])
        self.parts, self.n = [], 0
        bucket = ((tokens >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket * len(owners) + which, kind="stable")
        bucket, which = bucket[order], which[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (which[1:] != which[:-1])
        starts = np.flatnonzero(new)  # of an item within a bucket
        counts = np.diff(np.append(starts, len(order))).astype(np.uint32)
        last = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1  # ends of buckets, in tokens
        items, at = np.searchsorted(starts, last), which[starts]  # and in items
        rest = (tokens[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cols = [_binary(owners[at], items), _binary(counts, items), _binary(metas[at], items), _binary(rest, last), _binary(marks[order], last)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[last - 1], pa.int32()), *cols], NAMES)


def shuffled(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows of SCHEMA with those of a bucket one after the other in one task."""
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, meta, token, mark) of all entries of a bucket, bucket by bucket; sorted by token."""
    held, now = [], None

    def whole():
        cols = [b"".join(x[i] for x in held) for i in range(5)]
        counts = np.frombuffer(cols[1], np.uint32)
        tokens = np.frombuffer(cols[3], np.uint32)
        order = np.argsort(tokens, kind="stable")
        return np.repeat(np.frombuffer(cols[0], np.int64), counts)[order], np.repeat(np.frombuffer(cols[2], np.int32), counts)[order], tokens[order], np.frombuffer(cols[4], np.uint8)[order]

    for b in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now and held:
                yield whole()
                held = []
            now = bucket
            held.append(row)
    if held:
        yield whole()


def pairs_in_runs(tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of equal tokens in a sorted array, in pieces."""
    at, d = np.arange(len(tokens)), 0
    while True:
        d += 1
        at = at[at + d < len(tokens)]
        at = at[tokens[at + d] == tokens[at]]
        if not len(at):
            return
        yield at, at + d


def pieces_of(sizes: np.ndarray, most: int = 1_000_000) -> Iterator[np.ndarray]:
    """Places of ``sizes`` in pieces whose sum is about ``most`` at most."""
    piece = (np.cumsum(sizes) - sizes) // most
    yield from np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(piece)) + 1) if len(sizes) else ()


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches (a, b) of the different pairs among each ``most`` or so."""
    held, n = [], 0

    def give():
        a, b = np.concatenate(held, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(a[new], pa.int64()), pa.array(b[new], pa.int64())], ["a", "b"])

    for a, b in pairs:
        if len(a):
            held.append(np.stack([a, b]))
            n += len(a)
        if n >= most:
            yield give()
            held, n = [], 0
    if held:
        yield give()
