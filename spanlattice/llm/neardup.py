"""Near-duplicate images by the sequences of neighbouring grey levels they share: multiple-global-order filtering.

An image is the set of its different sequences of ``width`` neighbouring grey levels within a row. For a Jaccard similarity of at
least t, two sets share a token among the first |x| - ceil(t |x|) + 1 of each under *any* global order of tokens. So a
candidate has to pass this prefix filter under several orders: the first order proposes pairs by a join on prefix tokens; the further
orders are applied to the images still in some pair, and the pair sets are intersected before verification.

Each order ranks tokens by rarity class first (the logarithm of their count in a sketch of fixed size, so that what is common to many images
comes last in every order) and by a fresh hash within the class. The choice of orders steers cost only: no pair is lost.
Images of equal sets form a class. One image of a class takes part in the join; copies are expanded at the end, if at all.

Sets are never written: they are many times as large as the images and quickly made again from them, for all images of one
size together. Prefixes travel packed (spanlattice.llm.packed), with the tokens of hot lists spread over cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlattice.llm import packed
from spanlattice.llm.components import components
from spanlattice.llm.images import grey, level_groups, usable
from spanlattice.llm.packed import mix
from spanlattice.operators.skew import lookup
from spanlattice.session import Scratch

ORDERS = 3
#: Lower bits of a sort key that hold the token's place among those of its image.
COLUMN_BITS = 24


def sequences(levels: np.ndarray, h: int, w: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, new) of images of h x w, one per row of ``levels``: all their tokens, sorted in each row, and which of them are the first of equal ones.

    A token is ``width`` <= 8 neighbouring grey levels of an image row as one 64-bit number (no hashing).
    """
    if w < width:
        return np.zeros((len(levels), 0), np.uint64), np.zeros((len(levels), 0), bool)
    rows = levels.reshape(len(levels), h, w)
    key = np.zeros((len(levels), h, w - width + 1), np.uint64)
    for i in range(width):
        key = (key << np.uint64(8)) | rows[:, :, i : w - width + 1 + i]
    key = np.sort(key.reshape(len(levels), -1), axis=1)
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] != key[:, :-1]
    return key, new


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(np.round(t * n, 9)).astype(np.int64) + 1


def prefixes(tokens: np.ndarray, new: np.ndarray, rarity: np.ndarray, order: int, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place in the order) of the first tokens of each row's set; ``rarity`` has the class of each token."""
    length = prefix_length(new.sum(axis=1), t)
    # by class, then by the upper bits of the mixed token, then by the token itself, which is the order of the columns: so in all images alike
    low = np.uint64(2**COLUMN_BITS - 1)
    key = np.where(new, (rarity.astype(np.uint64) << np.uint64(58)) | (mix(tokens, order) >> np.uint64(6)), np.uint64(2**64 - 1)) & ~low
    if tokens.shape[1] <= low:  # the column fits into the lower bits, so that a plain sort does
        at = (np.sort(key | np.arange(tokens.shape[1], dtype=np.uint64), axis=1)[:, : length.max()] & low).astype(np.int64)
    else:
        at = np.argsort(key, axis=1, kind="stable")[:, : length.max()]
    row, pos = np.nonzero(np.arange(at.shape[1])[None, :] < length[:, None])
    return row, at[row, pos], pos


class NearDuplicates:
    """Similar pairs between classes of images, and which image belongs to which class; kept in scratch tables.

    ``member``: (patch_id, cls), one row per usable image. ``pairs``: (a, b), a < b, classes at least ``t`` similar.
    Rows without an id, unreadable and blank images and images narrower than ``width`` are in no pair and no class;
    repeated deliveries count once; empty tables give no row; further columns are not read. The caller may ``clear`` the
    ``scratch`` tables when the results are used.
    """

    def __init__(self, patches: DataFrame, t: float = 0.6, width: int = 8, orders: int = ORDERS, scratch: Scratch | None = None, list_limit: int | None = None):
        spark = patches.sparkSession
        self.scratch = scratch = scratch or Scratch(spark, "neardup")
        given = usable(patches)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each image, and at the end the task's counters of tokens."""
            total = np.zeros(1 << packed.SKETCH_BITS, np.int64)
            names = ["patch_id", "size", "sig", "block", "counts"]
            for b in batches:
                ids = b.column(0).to_numpy()
                for at, levels, h, w in level_groups(b):
                    tokens, new = sequences(levels, h, w, width)
                    if not tokens.size:
                        continue
                    sizes, tokens = new.sum(axis=1), tokens[new]
                    total += np.bincount(packed.slot(mix(tokens, -1)), minlength=len(total))
                    raw, ends = tokens.tobytes(), np.cumsum(sizes) * 8
                    sig = [blake2b(raw[z - 8 * n : z], digest_size=16).hexdigest() for n, z in zip(sizes.tolist(), ends.tolist())]
                    n = len(sig)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(sizes.astype(np.int32)), pa.array(sig), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            at, blocks = packed.sketch_rows(total)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.array(at, pa.int32()), pa.array(blocks, pa.binary())], names)

        looked = scratch.keep(given.mapInArrow(look, "patch_id bigint, size int, sig string, block int, counts binary"))
        seen = packed.gather_sketch(looked.filter("block is not null"))
        sets = looked.filter("patch_id is not null").select("patch_id", "size", "sig")
        classes = sets.groupBy("sig").agg(F.min("patch_id").alias("cls"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
        classes = scratch.keep(classes)
        n_sets, n_tokens = classes.agg(F.sum("n"), F.sum("size")).first()
        self.member = scratch.keep(lookup(sets, "sig", classes, "sig", "cls", n_sets or 0, F.concat(F.lit("#"), "patch_id")).select("patch_id", "cls").distinct())
        scratch.drop(looked)

        rarity = np.frexp(seen.astype(np.float64))[1].astype(np.uint8)
        shared = spark.sparkContext.broadcast((rarity, packed.cells_of_lists(seen, list_limit)))  # 2^SKETCH_BITS counters; arrays only, as executors need no copy of the package

        def pairs_under(order: int, images: DataFrame) -> DataFrame:
            """Pairs (a, b), a < b, with a common prefix token that pass the length and the position filter."""

            def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rarity, cells = shared.value
                packer = packed.Packer(buckets)
                for b in batches:
                    ids = b.column(0).to_numpy()
                    for at, levels, h, w in level_groups(b):
                        tokens, new = sequences(levels, h, w, width)
                        if not tokens.size:
                            continue
                        slots, sizes = packed.slot(mix(tokens, -1)), new.sum(axis=1)
                        which, first, pos = prefixes(tokens, new, rarity[slots], order, t)
                        mark = (pos * 256 // prefix_length(sizes, t)[which]).astype(np.uint8)
                        entry, key = packed.in_cells(mix(tokens[which, first], order), cells[slots[which, first]], mix(ids[at].view(np.uint64), 11)[which], True)
                        yield from packer.add(ids[at], sizes, which[entry], key, mark[entry])
                yield from packer.flush()

            def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def candidates():
                    for owner, meta, token, mark in packed.buckets_of(batches):
                        size = meta.astype(np.int64)
                        pos = -(-mark.astype(np.int64) * prefix_length(size, t) // 256)  # the place in the prefix, or a little less
                        for i, j in packed.pairs_in_runs(token):
                            na, nb = size[i], size[j]
                            # both tokens are the first common one for some candidate row of the pair, so this row passes if the pair is similar
                            ahead = np.minimum(na - pos[i], nb - pos[j])
                            ok = (owner[i] != owner[j]) & (np.minimum(na, nb) + 1e-9 >= np.maximum(na, nb) * t) & (ahead + 1e-9 >= (na + nb) * (t / (1 + t)))
                            yield np.minimum(owner[i[ok]], owner[j[ok]]), np.maximum(owner[i[ok]], owner[j[ok]])

                return packed.gathered(candidates())

            return packed.shuffled(images.mapInArrow(pack, packed.SCHEMA), buckets).mapInArrow(meet, "a bigint, b bigint").distinct()

        buckets = packed.buckets_for(spark, int((n_tokens or 0) * (1 - t)))
        copies = scratch.keep(self.member.filter("patch_id <> cls").select("patch_id"))
        pairs = scratch.keep(pairs_under(0, given.join(copies, "patch_id", "left_anti")))
        alive = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("patch_id")).distinct())
        # the other images are not read again; a repeated delivery may stay, its pairs are the same
        reps = scratch.keep(given.join(alive, "patch_id", "left_semi"))
        buckets = packed.buckets_for(spark, int((n_tokens or 0) * (1 - t) * reps.count() / max(n_sets or 0, 1)))
        for order in range(1, orders):
            fewer = scratch.keep(pairs.join(pairs_under(order, reps), ["a", "b"], "left_semi"))
            scratch.drop(pairs)
            pairs = fewer

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                ok = []
                for ha, wa, da, x, hb, wb, db, y in zip(*cols[2:]):
                    (u, new_u), (v, new_v) = sequences(grey(x, da)[None, :], ha, wa, width), sequences(grey(y, db)[None, :], hb, wb, width)
                    common = len(np.intersect1d(u[new_u], v[new_v], assume_unique=True))
                    ok.append(common + 1e-9 >= t * (new_u.sum() + new_v.sum() - common))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        once = reps.dropDuplicates(["patch_id"])
        side = lambda k: once.select(F.col("patch_id").alias(k), *[F.col(c).alias(c + k) for c in ("h", "w", "wide", "image")])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        self.pairs = scratch.keep(both.select("a", "b", *[c + k for k in "ab" for c in ("h", "w", "wide", "image")]).mapInArrow(verify, "a bigint, b bigint"))
        scratch.drop(pairs)
        scratch.drop(reps)

    def image_pairs(self) -> DataFrame:
        """(patch_id1, patch_id2), patch_id1 < patch_id2: all similar pairs, copies included."""
        left, right = self.member.select(F.col("patch_id").alias("p"), F.col("cls").alias("a")), self.member.select(F.col("patch_id").alias("q"), F.col("cls").alias("b"))
        across = self.pairs.join(left, "a").join(right, "b").select("p", "q")
        within = left.join(right, F.col("a") == F.col("b")).filter("p < q").select("p", "q")
        return across.unionAll(within).select(F.least("p", "q").alias("patch_id1"), F.greatest("p", "q").alias("patch_id2"))

    def image_groups(self) -> DataFrame:
        """(patch_id, class_id, n_links, group_id): its class, the similar classes, and the least image linked to it directly or over others."""
        links = self.pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
        root = components(self.pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), self.scratch)
        least = root.groupBy("root").agg(F.min("v").alias("group_id"))
        named = root.join(least, "root").select(F.col("v").alias("cls"), "group_id")
        return self.member.join(links, "cls", "left").join(named, "cls", "left").select("patch_id", F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "cls").alias("group_id"))
