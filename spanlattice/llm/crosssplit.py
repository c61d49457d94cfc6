"""Same or almost same images across splits: an exact prefix-filter bipartite join on rare shingles.

Two images match if at least a share ``agree`` of their pixels differ by at most ``tolerance`` grey levels, so a pair has at
most ``bad = n - ceil(agree * n)`` other pixels. The pixels are dealt into g > bad disjoint shingles of a few pixels
that lie far apart. In a matching pair at least g - bad shingles are free of bad pixels, and for such a shingle the training
image's token (its position and its pixels' levels in steps of STEP) is one of the few tokens that the evaluation image's
levels, moved by up to ``tolerance``, can give. Therefore

* any bad + 1 shingles of an evaluation image contain a clean one: the index holds the tokens of the bad + 1 rarest ones;
* a training image is probed with its tokens, at equal height, width and shingle position (length and position filter);
* candidates are verified on all pixels.

No pair is lost. Rarity comes from a count sketch of fixed size and steers only which shingles are indexed. Images of equal
grey levels form a class; only one image of a class takes part in the join, and pairs are expanded at the end. Tokens
travel packed (spanlattice.llm.packed), made for all images of one size together, and hot ones are spread over cells.
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
from spanlattice.llm.images import clean_path, grey, level_groups, parents, usable
from spanlattice.llm.packed import mix
from spanlattice.operators.skew import lookup
from spanlattice.session import Scratch

#: Width of a level step in a token; at 14, a level moved by up to 3 meets 1.43 steps on average.
STEP = 14
#: Pixels of a shingle: more make tokens rarer, and give more tokens to an indexed shingle.
SHINGLE = 6


def max_bad(n: int, agree: float) -> int:
    return n - math.ceil(round(agree * n, 9))


def shingle_pixels(n: int, agree: float) -> np.ndarray:
    """(g, s) pixel numbers of the shingles of an image of n pixels, g > max_bad(n); each pixel occurs at most once.

    Pixel i of a shingle comes from the i-th part of the image, so that its pixels are far apart.
    """
    size = min(SHINGLE, n // (max_bad(n, agree) + 1))
    g = n // size
    return (np.arange(g)[:, None] + g * np.arange(size)[None, :]).astype(np.int64)


def _token(h: int, w: int, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """64-bit tokens of step numbers, five bits each in ``key``, at shingle positions ``at``, for images of h x w."""
    return mix(mix(key) ^ mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((h << 32) | w), 1), 2)


def probe_tokens(levels: np.ndarray, h: int, w: int, agree: float) -> np.ndarray:
    """The token of each shingle, for each image a row."""
    px = shingle_pixels(h * w, agree)
    steps = (levels // STEP).astype(np.uint64)
    key = np.zeros((len(levels), len(px)), np.uint64)
    for i in range(px.shape[1]):
        key = (key << np.uint64(5)) | steps[:, px[:, i]]
    return _token(h, w, np.arange(len(px))[None, :], key)


def index_tokens(levels: np.ndarray, h: int, w: int, agree: float, tolerance: int, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image, token): for each image, a row of ``levels``, the tokens of its bad + 1 rarest shingles that levels moved by up to ``tolerance`` can give."""
    px = shingle_pixels(h * w, agree)
    low = (np.maximum(levels.astype(np.int16) - tolerance, 0) // STEP).astype(np.uint64)
    high = (np.minimum(levels.astype(np.int16) + tolerance, 255) // STEP).astype(np.uint64)
    many = np.prod((high - low + np.uint64(1))[:, px], axis=2, dtype=np.int64)
    cost = sketch[packed.slot(probe_tokens(levels, h, w, agree))] * many
    rows = np.argsort(cost, axis=1, kind="stable")[:, : max_bad(h * w, agree) + 1].reshape(-1)
    image = np.repeat(np.arange(len(levels)), len(rows) // len(levels))
    key = np.zeros(len(rows), np.uint64)
    for i in range(px.shape[1]):  # a step is wider than 2 * tolerance: one step or two
        a, b = low[image, px[rows, i]], high[image, px[rows, i]]
        two = b > a
        key = np.concatenate([(key << np.uint64(5)) | a, (key[two] << np.uint64(5)) | b[two]])
        rows, image = np.concatenate([rows, rows[two]]), np.concatenate([image, image[two]])
    return image, _token(h, w, rows, key)


def agreeing(a: np.ndarray, b: np.ndarray, tolerance: int) -> int:
    return int((np.abs(a.astype(np.int16) - b.astype(np.int16)) <= tolerance).sum())


def placed_patches(patches: DataFrame, config: DataFrame) -> DataFrame:
    """(run_name, is_eval, patch_id, dataset) for each directory role that a run gives a patch; paths see clean_path."""
    trains = F.array_union(F.array("train_dir"), F.coalesce(F.col("additional_train_dirs"), F.array().cast("array<string>")))
    roles = config.select("run_name", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("is_eval"), F.col("eval_dir").alias("dir"))), F.transform(trains, lambda d: F.struct(F.lit(False).alias("is_eval"), d.alias("dir"))))).alias("r"))
    roles = roles.select("run_name", "r.is_eval", clean_path(F.col("r.dir")).alias("dir")).filter("dir is not null and run_name is not null").distinct()
    below = patches.select("patch_id", "dataset", F.explode(parents(clean_path(F.col("file_path")))).alias("dir"))
    return below.join(roles, "dir").select("run_name", "is_eval", "patch_id", "dataset").distinct()


#: Roles of a class in the join.
PROBED, INDEXED = 1, 2


class CrossSplit:
    """Matches between classes of images, which image belongs to which class, and which run uses it how; kept in scratch tables.

    ``placed``: (run_name, is_eval, patch_id, dataset, cls); ``pairs``: (a, b), matching classes of which ``a`` occurs on an evaluation
    side and ``b`` on a training side, also a = b. Rows without an id, unreadable and blank images are left out; repeated deliveries
    count once; null, empty and repeated directories mean nothing; all rows of a run count together; empty tables give no row;
    further columns are not read. The caller may ``clear`` the ``scratch`` tables when the results are used.
    """

    def __init__(self, patches: DataFrame, config: DataFrame, agree: float = 0.95, tolerance: int = 3, scratch: Scratch | None = None, list_limit: int | None = None):
        if 2 * tolerance >= STEP:
            raise ValueError(f"tolerance must be less than {STEP // 2}")
        spark = patches.sparkSession
        self.scratch = scratch = scratch or Scratch(spark, "crosssplit")
        given = usable(patches)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each image, and at the end the task's counters of tokens."""
            total = np.zeros(1 << packed.SKETCH_BITS, np.int64)
            n_tokens = 0
            names = ["patch_id", "n_tokens", "sig", "block", "counts"]
            for b in batches:
                ids = b.column(0).to_numpy()
                for at, levels, h, w in level_groups(b):
                    tokens = probe_tokens(levels, h, w, agree)
                    total += np.bincount(packed.slot(tokens.reshape(-1)), minlength=len(total))
                    sig = [f"{h} {w} " + blake2b(x.tobytes(), digest_size=16).hexdigest() for x in levels]
                    n = len(sig)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(n, tokens.shape[1], np.int32)), pa.array(sig), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            at, blocks = packed.sketch_rows(total)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.array(at, pa.int32()), pa.array(blocks, pa.binary())], names)

        looked = scratch.keep(given.mapInArrow(look, "patch_id bigint, n_tokens int, sig string, block int, counts binary"))
        seen = packed.gather_sketch(looked.filter("block is not null"))
        images = looked.filter("patch_id is not null").select("patch_id", "n_tokens", "sig").dropDuplicates(["patch_id"])
        roles = placed_patches(patches.filter("patch_id is not null"), config)
        roles = scratch.keep(roles.join(images, "patch_id"))
        role = F.when(F.col("is_eval"), INDEXED).otherwise(PROBED)
        classes = scratch.keep(roles.groupBy("sig").agg(F.min("patch_id").alias("cls"), F.bit_or(role).alias("role"), F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n")))
        n_roles, n_tokens = classes.agg(F.sum("n"), F.sum("n_tokens")).first()
        self.placed = scratch.keep(lookup(roles, "sig", classes, "sig", "cls", n_roles or 0, F.concat(F.lit("#"), "patch_id")).drop("sig", "n_tokens"))
        scratch.drop(roles)
        # what is not a plain training image: others' copies, images of no run, and evaluation images
        special = scratch.keep(images.select("patch_id").join(classes.select(F.col("cls").alias("patch_id"), "role"), "patch_id", "left").filter(f"role is null or role <> {PROBED}").na.fill(0, ["role"]))
        scratch.drop(looked)
        reps = given.join(special, "patch_id", "left").na.fill(PROBED, ["role"]).filter("role > 0").select("patch_id", "h", "w", "wide", "image", "role")

        buckets = packed.buckets_for(spark, int(n_tokens or 0))
        shared = spark.sparkContext.broadcast((seen, packed.cells_of_lists(seen, list_limit)))  # 2^SKETCH_BITS counters

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketch, cells = shared.value
            packer = packed.Packer(buckets)
            for b in batches:
                ids, roles = b.column(0).to_numpy(), b.column(5).to_numpy()
                for at, levels, h, w in level_groups(b):
                    for side in (PROBED, INDEXED):
                        k = np.flatnonzero(roles[at] & side)
                        if not len(k):
                            continue
                        own = ids[at[k]]
                        if side == PROBED:
                            tokens = probe_tokens(levels[k], h, w, agree)
                            which, tokens = np.repeat(np.arange(len(k)), tokens.shape[1]), tokens.reshape(-1)
                        else:
                            which, tokens = index_tokens(levels[k], h, w, agree, tolerance, sketch)
                        entry, key = packed.in_cells(tokens, cells[packed.slot(tokens)], mix(own.view(np.uint64), 11)[which], False, side == INDEXED)
                        yield from packer.add(own, np.full(len(k), side), which[entry], key)
            yield from packer.flush()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def candidates():
                for owner, side, token, _ in packed.buckets_of(batches):
                    a, b = side == INDEXED, side == PROBED
                    left, right, ids = token[a], token[b], owner[b]
                    from_, to = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
                    hit = np.flatnonzero(to > from_)
                    for k in packed.pieces_of(to[hit] - from_[hit]):
                        n = to[hit[k]] - from_[hit[k]]
                        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(from_[hit[k]], n)
                        x, y = np.repeat(owner[a][hit[k]], n), ids[at]
                        yield x[x != y], y[x != y]

            return packed.gathered(candidates())

        pairs = scratch.keep(packed.shuffled(reps.mapInArrow(pack, packed.SCHEMA), buckets).mapInArrow(meet, "a bigint, b bigint").distinct())
        alive = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("patch_id")).distinct())
        once = scratch.keep(given.join(alive, "patch_id", "left_semi")).dropDuplicates(["patch_id"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = []
                for ha, wa, da, x, hb, wb, db, y in zip(*(c.to_pylist() for c in b.columns[2:])):
                    n = ha * wa
                    ok.append((ha, wa) == (hb, wb) and agreeing(grey(x, da), grey(y, db), tolerance) >= n - max_bad(n, agree))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        side = lambda k: once.select(F.col("patch_id").alias(k), *[F.col(c).alias(c + k) for c in ("h", "w", "wide", "image")])
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[c + k for k in "ab" for c in ("h", "w", "wide", "image")])
        same = classes.filter(f"role = {PROBED | INDEXED}").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
        self.pairs = scratch.keep(both.mapInArrow(verify, "a bigint, b bigint").unionAll(same))
        scratch.drop(pairs)

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        left = self.placed.filter("is_eval").select("run_name", "dataset", F.col("patch_id").alias("p"), F.col("cls").alias("a"))
        return left, self.placed.filter("not is_eval").select("run_name", F.col("patch_id").alias("q"), F.col("cls").alias("b")).distinct()

    def image_pairs(self) -> DataFrame:
        """Rows (run_name, dataset, patch_id1, patch_id2), patch_id1 < patch_id2: all matches, copies included.

        One patch lies below the run's ``eval_dir``, the other below its ``train_dir`` or one of ``additional_train_dirs``;
        ``dataset`` is that of the evaluation patch (possibly null).
        """
        left, right = self._sides()
        out = left.join(self.pairs, "a").join(right, ["run_name", "b"]).filter("p <> q")
        return out.select("run_name", "dataset", F.least("p", "q").alias("patch_id1"), F.greatest("p", "q").alias("patch_id2")).distinct()

    def images(self) -> DataFrame:
        """(run_name, dataset, patch_id, class_id, n_links): each evaluation image that has a match, its class, and how many classes with a training image of the run match; the compact form of image_pairs."""
        left, right = self._sides()
        run = right.groupBy("run_name", "b").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("q"))
        out = left.join(self.pairs, "a").join(run, ["run_name", "b"]).filter("n > 1 or q <> p")
        return out.groupBy("run_name", "dataset", F.col("p").alias("patch_id"), F.col("a").alias("class_id")).agg(F.count(F.lit(1)).alias("n_links"))


def cross_split(patches: DataFrame, config: DataFrame, agree: float = 0.95, tolerance: int = 3) -> DataFrame:
    """CrossSplit(...).image_pairs()."""
    got = CrossSplit(patches, config, agree, tolerance)
    return got.scratch.handed(got.image_pairs())


def overlap_report(found: DataFrame) -> DataFrame:
    """Rows (run_name, dataset, n_pairs) from the rows of cross_split."""
    return found.groupBy("run_name", "dataset").agg(F.count(F.lit(1)).alias("n_pairs"))
