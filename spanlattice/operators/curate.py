"""Dataset curation: names, patches, hashes, weights, sampling, merging of directories."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlattice.operators.graph import components
from spanlattice.operators.grouping import by_key
from spanlattice.session import Scratch

#: Markers between a data set's name and what follows, in the order in which they are tried.
MARKERS = ("-ROI-", "-LOC-2d-", "-LOC-")


def dataset_name(name: Column) -> Column:
    """What comes before the first marker that occurs; the whole name without any; null for null."""
    out = name
    for m in reversed(MARKERS):
        out = F.when(F.contains(name, F.lit(m)), F.substring_index(name, m, 1)).otherwise(out)
    return out


def parse_location(name: Column) -> Column:
    """struct(dataset, axis, idx, y0, y1, x0, x1) of '<dataset>-LOC-<axis>_<idx>_<y0>-<y1>_<x0>-<x1>'; null fields if it isn't one."""
    pattern = r"^(.*)-(?:ROI|LOC-2d|LOC)-([a-z0-9]+)_(\d+)_(\d+)-(\d+)_(\d+)-(\d+)"
    part = lambda n: F.nullif(F.regexp_extract(name, pattern, n), F.lit(""))
    return F.struct(part(1).alias("dataset"), part(2).alias("axis"), *[part(n).cast("int").alias(c) for n, c in enumerate(("idx", "y0", "y1", "x0", "x1"), 3)])


def flipbook_span(idx: Column, n: int, length: Column) -> Column:
    """struct(low, high) of the n // 2 slices to either side; null where it leaves [0, length)."""
    if n % 2 == 0:
        raise ValueError("n must be odd")
    low, high = idx - n // 2, idx + n // 2
    return F.when((low >= 0) & (high < length), F.struct(low.alias("low"), high.alias("high")))


def middle_slice(start: Column, end: Column) -> Column:
    return (start + F.floor((end - start) / 2)).cast("int")


def patch_grid(images: DataFrame, height: str, width: str, crop: int) -> DataFrame:
    """Adds y0, y1, x0, x1 of max(1, round(size / crop)) patches along either side, the last one clipped (halves round to even)."""
    n = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) / crop).cast("int"))
    out = images.withColumn("_i", F.explode(F.sequence(F.lit(0), n(height) - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), n(width) - 1)))
    out = out.withColumn("y0", F.col("_i") * crop).withColumn("y1", F.least(F.col("y0") + crop, F.col(height))).withColumn("x0", F.col("_j") * crop).withColumn("x1", F.least(F.col("x0") + crop, F.col(width)))
    return out.drop("_i", "_j")


def difference_hash(values: Column, size: int = 8) -> Column:
    """bigint of size x size bits, in raster order from the highest: whether a value is greater than its left neighbour, of size x (size + 1) pooled values."""
    bits = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.element_at(values, r * (size + 1) + c + 2) > F.element_at(values, r * (size + 1) + c + 1))))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("bigint")))


def pooled_means(images: DataFrame, ident: str, data: str, dtype: str, height: Column, width: Column, size: int = 8) -> DataFrame:
    """(ident, values array<double>): images of uint8 or little-endian uint16 pooled to size x (size + 1) means, row by row.

    Row y goes to row y * size div h of the means and column x to column x * (size + 1) div w; where an image is smaller than that, a mean without
    pixels is that of the pixel at its place. Null ids and arrays whose bytes do not fit their dimensions are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, kind, h, w in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                a = np.frombuffer(raw, "u1" if kind == "uint8" else "<u2").astype(np.int64).reshape(h, w)
                at = (np.arange(h) * size // h)[:, None] * (size + 1) + np.arange(w) * (size + 1) // w
                n, total = np.bincount(at.reshape(-1), minlength=size * (size + 1)), np.bincount(at.reshape(-1), a.reshape(-1), size * (size + 1))
                near = a[(np.arange(size) * h // size)[:, None], np.arange(size + 1) * w // (size + 1)].reshape(-1)
                out.append(np.where(n > 0, total / np.maximum(n, 1), near).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], [ident, "values"])

    bytes_of = F.when(F.col(dtype) == "uint8", 1).when(F.col(dtype) == "uint16", 2)
    fits = (height > 0) & (width > 0) & (F.octet_length(data) == F.try_multiply(F.try_multiply(height.cast("bigint"), width.cast("bigint")), bytes_of))
    good = images.filter(F.col(ident).isNotNull() & F.coalesce(fits, F.lit(False))).select(ident, data, dtype, height.cast("int").alias("h"), width.cast("int").alias("w"))
    return good.mapInArrow(run, f"`{ident}` {images.schema[ident].dataType.simpleString()}, values array<double>")


def sign_hash(values: Column, bits: int = 32) -> Column:
    """bigint of the signs of the first ``bits`` elements, the first one highest."""
    return F.aggregate(F.slice(values, 1, bits), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x > 0).cast("bigint")))


def hash_classes(df: DataFrame, ident: str, hash_: str) -> DataFrame:
    """(id, class_id, h): items of equal hash are a class under its least id; null ids and hashes are left out."""
    known = df.filter(F.col(ident).isNotNull() & F.col(hash_).isNotNull()).select(F.col(ident).alias("id"), F.col(hash_).alias("h")).distinct()
    return known.join(known.groupBy("h").agg(F.min("id").alias("class_id")), "h").select("id", "class_id", "h")


def hash_pairs(classes: DataFrame, distance: int, bits: int, together: int = 1, within: str | None = None) -> DataFrame:
    """(a, b, dist), a < b: all pairs of classes (see hash_classes) whose hashes differ in at most ``distance`` bits.

    The hash is cut into distance + together bands: a pair within the distance agrees on at least ``together`` of them, so every
    choice of so many bands is a key. More bands in a key make more keys and far fewer pairs to compare on each; use 2 or 3 for
    many items. Members of a class never meet here. With ``within``, a column, only items of equal values are compared.
    """
    bands = min(distance + together, bits)
    together = max(1, bands - distance)
    cut = [round(bits * k / bands) for k in range(bands + 1)]
    values = classes.filter("id = class_id").select("id", "h", *[within] * bool(within))
    band = lambda k: F.shiftrightunsigned("h", cut[k]).bitwiseAND((1 << (cut[k + 1] - cut[k])) - 1)
    keys = [F.xxhash64(F.lit(n), *map(band, chosen), *[within] * bool(within)) for n, chosen in enumerate(combinations(range(bands), together))]
    place = F.col(within) if within else F.lit(0)
    banded = values.select(F.col("id").alias("a"), F.col("h").alias("g"), place.alias("wa"), F.explode(F.array(*keys)).alias("key"))
    other = banded.select(F.col("a").alias("b"), F.col("g").alias("h"), F.col("wa").alias("wb"), "key")
    dist = F.bit_count(F.col("g").bitwiseXOR(F.col("h"))).cast("int")
    return banded.join(other, "key").filter((F.col("a") < F.col("b")) & (dist <= distance) & F.col("wa").eqNullSafe(F.col("wb"))).select("a", "b", dist.alias("dist")).distinct()


def exemplars(nodes: DataFrame, ident: str, pairs: DataFrame, scratch: Scratch, seed: int = 0, by_id: bool = False) -> DataFrame:
    """Greedy exemplars in a seeded random order (or that of the ids): the first stays and all close to it go, and so on. One column, ``ident``.

    Rounds: every item that comes before all its undecided neighbours stays, its neighbours go. This gives just what the sequential
    rule gives, in a number of rounds that grows with the logarithm of the longest decreasing chain.
    """
    rank = (lambda c: F.col(c).cast("bigint")) if by_id else (lambda c: F.xxhash64(F.lit(seed).cast("bigint"), F.col(c)))
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = scratch.keep(both.filter("u <> v").distinct())
    linked = edges.select(F.col("u").alias(ident)).distinct()
    kept = nodes.select(ident).distinct().join(linked, ident, "left_anti")
    while edges.limit(1).count():
        first = edges.groupBy("u").agg(F.min(rank("v")).alias("m")).filter(rank("u") < F.col("m")).select("u")
        first = scratch.keep(first)
        gone = edges.join(first, "u", "left_semi").select(F.col("v").alias("u")).unionAll(first).distinct()
        gone = scratch.keep(gone)
        left = edges.join(gone, "u", "left_anti").join(gone.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v")
        free = edges.select("u").distinct().join(gone, "u", "left_anti").join(left.select("u").distinct(), "u", "left_anti")
        kept = kept.unionAll(scratch.keep(first.unionAll(free)).withColumnRenamed("u", ident))
        edges = scratch.keep(left)
    return kept


#: Items of a place in the first slice of near_exemplars, and items of a slice that one group holds against the exemplars found so far.
SLICE, CHUNK = 20_000, 100_000


def near_exemplars(items: DataFrame, distance: int, within: str, scratch: Scratch, seed: int = 0, first: int | None = None, chunk: int | None = None) -> DataFrame:
    """(id): what ``exemplars`` keeps of items (id, h, ``within``), those of equal ``within`` whose hashes differ in at most ``distance`` bits being close.

    No pairs are listed. The random order is gone through in slices, each as long as all before it: of a slice only what is close to
    no exemplar so far (in chunks, each held against the exemplars of its place) goes to the sequential rule, one group for each place. Shuffled
    are the items once, and the exemplars once for each chunk of a place. ``first`` and ``chunk`` see SLICE and CHUNK.
    """
    first, chunk = first or SLICE, chunk or CHUNK
    rank = F.xxhash64(F.lit(seed).cast("bigint"), "id")
    own = scratch.keep(items.select("id", "h", F.col(within).alias("w"), rank.alias("r")))
    most = own.groupBy("w").count().agg(F.max("count")).first()[0] or 0

    def bits(rows: list[tuple]) -> np.ndarray:
        return np.array([r[2] for r in rows], np.int64).view(np.uint64)  # of a negative number its absolute value would be counted

    def near(h: np.uint64, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(others ^ h) <= distance

    def apart(rows: list[tuple]) -> list[tuple]:
        """Of a chunk, what no exemplar is close to."""
        left = [r for r in rows if not r[4]]
        h, at = bits(left), np.arange(len(left))
        for e in bits([r for r in rows if r[4]]):
            if not len(at):
                break
            close = near(e, h)
            if close.any():
                at, h = at[~close], h[~close]
        return [(left[i][0]["w"], *left[i][1:4]) for i in at]

    def greedy(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r[3], r[1]))
        h, at, stays = bits(rows), np.arange(len(rows)), []
        while len(at):
            stays.append(rows[at[0]])
            left = ~near(h[0], h)
            at, h = at[left], h[left]
        return stays

    schema = own.select("w", "id", "h", "r").schema
    found, share, done = None, first / max(most, first), 0.0
    while done < 1:
        low, high = (int(f * 2**64) - 2**63 for f in (done, share))
        new = own.filter(F.col("r") >= low) if share >= 1 else own.filter((F.col("r") >= low) & (F.col("r") < high))
        if found is not None:
            chunks = -(-int(most * (share - done)) // chunk)
            cell = lambda n: F.struct("w", n.cast("bigint").alias("n")).alias("cell")
            known = found.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(cell(F.col("n")), "id", "h", "r", F.lit(True).alias("known"))
            both = new.select(cell(F.pmod("r", F.lit(chunks))), "id", "h", "r", F.lit(False).alias("known")).unionAll(known)
            new = by_key(both, "cell", apart, schema)
        got = scratch.keep(by_key(new.select("w", "id", "h", "r"), "w", greedy, schema))
        found = got if found is None else found.unionAll(got)
        done, share = share, min(1.0, 2 * share)
    return found.select("id")


def example_weights(df: DataFrame, group: str, gamma: float = 0.3) -> DataFrame:
    """(group, n, weight): (1 / n) ^ gamma, scaled to add up to 1 over the groups."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_w", F.pow(1.0 / F.col("n"), F.lit(gamma)))
    total = n.agg(F.sum("_w").alias("_t"))  # one row
    return n.crossJoin(F.broadcast(total)).select(group, "n", (F.col("_w") / F.col("_t")).alias("weight"))


def weighted_sample(df: DataFrame, ident: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn without replacement with chances in proportion to ``weight``: the greatest log(u) / weight, u a hash of the id.

    Two quantiles enclose the last key that is drawn; only the rows between them, a few in ten thousand, are sorted. Weights that are null
    or not above 0 are never drawn; with fewer than ``n`` others all are.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("bigint"), ident), 11).cast("double") + 1.0) / float(2**53 + 1)
    keyed = df.filter(F.col(weight) > 0).withColumn("_k", F.log(u) / F.col(weight))
    total = keyed.count()
    if total <= n:
        return keyed.drop("_k")
    edge = [min(1.0, max(0.0, 1 - n / total + d)) for d in (-4e-4, 4e-4)]
    low, high = keyed.agg(F.percentile_approx("_k", edge, 10_000)).first()[0]
    sure = keyed.filter(F.col("_k") > high)
    between = keyed.filter((F.col("_k") >= low) & (F.col("_k") <= high))
    return sure.unionAll(between.orderBy(F.desc("_k"), ident).limit(n - sure.count())).drop("_k")


def sample_per_group(df: DataFrame, group: str, ident: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group, by a seeded hash of the id."""
    order = W.partitionBy(group).orderBy(F.xxhash64(F.lit(seed).cast("bigint"), ident), ident)
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def quality_filter(df: DataFrame, score: Column, threshold: float, ident: str, keep_share: float, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Adds ``kept``: scores at or above the threshold, and a seeded share of the others. A null score is below. ``draw`` replaces the hash: numbers in [0, 1)."""
    u = F.pmod(F.xxhash64(F.lit(seed).cast("bigint"), ident), F.lit(1_000_000)) / 1_000_000 if draw is None else draw
    return df.withColumn("kept", F.coalesce(score >= threshold, F.lit(False)) | (u < keep_share))


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the most frequent value of each key; ties: the least. Null values do not count."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), value)).alias("_x")).select(*keys, F.col("_x")[value].alias(value))


def name_sets(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(name, side): the different names in ``both`` and in ``only`` the first."""
    both = a.select(name).intersect(b.select(name)).withColumn("side", F.lit("both"))
    return both.unionAll(a.select(name).distinct().subtract(b.select(name)).withColumn("side", F.lit("only")))


def merge_directories(src: DataFrame, dst: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, origin) of both sides; where both have the key, the source's value holds. origin: both, source or target."""
    a, b = src.select(key, F.col(value).alias("_a"), F.lit(1).alias("_s")), dst.select(key, F.col(value).alias("_b"), F.lit(1).alias("_d"))
    origin = F.when(F.col("_s").isNotNull() & F.col("_d").isNotNull(), "both").when(F.col("_s").isNotNull(), "source").otherwise("target")
    return a.join(b, key, "full").select(key, F.when(F.col("_s").isNotNull(), F.col("_a")).otherwise(F.col("_b")).alias(value), origin.alias("origin"))


def regroup(df: DataFrame, names: DataFrame, name: str, strip: str, marker: str) -> DataFrame:
    """Adds ``group``: ``strip`` taken off the name, what comes before ``marker`` looked up in names (code, group)."""
    coded = df.withColumn("_code", F.substring_index(F.regexp_replace(F.col(name), f"^{strip}", ""), marker, 1))
    return coded.join(names.select(F.col("code").alias("_code"), "group"), "_code", "left").drop("_code")


def proof_batch(images: DataFrame, masks: DataFrame, confidences: DataFrame, name: str) -> DataFrame:
    """Images, masks and confidences of a name, joined on it; a name missing anywhere is left out."""
    return images.join(masks, name).join(confidences, name).withColumn("dataset", dataset_name(F.col(name)))


def children(volumes: DataFrame, images: DataFrame) -> DataFrame:
    """(volume, image): images of the volume's directory whose names contain its name. Columns directory and name on both sides."""
    i = images.select("directory", F.col("name").alias("image"))
    return volumes.select("directory", F.col("name").alias("volume")).join(i, "directory").filter(F.contains("image", "volume")).select("volume", "image")


def content_extent(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, h, w) up to the last row and column with a value other than 0."""
    return pixels.filter(F.col(value) != 0).groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def volume_slices(volumes: DataFrame, spacing: int, done: DataFrame | None = None) -> DataFrame:
    """(name, axis, idx) of the slices to export from (name, d, h, w, px, pz): every ``spacing``-th, the last one excluded.

    All axes of isotropic volumes; axis 0 only if |px - pz| / px is above 0.25 or the name contains 'video'. ``done`` (name, axis, idx) is skipped.
    """
    flat = (F.abs(F.col("px") - F.col("pz")) / F.col("px") > 0.25) | F.contains(F.lower("name"), F.lit("video"))
    n = F.when(flat, F.array("d")).otherwise(F.array("d", "h", "w"))
    out = volumes.select("name", F.posexplode(n).alias("axis", "n")).filter("n > 1").select("name", "axis", F.explode(F.sequence(F.lit(0), F.col("n") - 2, F.lit(spacing))).alias("idx"))
    return out if done is None else out.join(done, ["name", "axis", "idx"], "left_anti")


def near_groups(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, group): ids linked by pairs (a, b), directly or over others."""
    return components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).select(F.col("v").alias("id"), F.col("component").alias("group"))
