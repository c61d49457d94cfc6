import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlattice.operators import curate
from spanlattice.operators.periods import periods_and_gaps
from spanlattice.plans import registry
from spanlattice.plans.orthoplane import consensus_volume, slice_objects
from spanlattice.session import Scratch
from spanlattice.sources import arrays, config, formats, images, trackers, volume
from spanlattice.streaming.median import MedianQueue, median_stream, recursive_median, sliding_median
from spanlattice.streaming.periods import period_stream
from spanlattice.streaming.tracking import match_stream


@pytest.mark.parametrize("chunks", [(3, 4, 5), (10, 2, 7), (1, 1, 1)])
def test_block_volume(spark, tmp_path, chunks):
    rng = np.random.default_rng(1)
    vol = rng.integers(0, 3, (6, 7, 8))
    flat = vol.ravel()
    runs = [(i, i + 1, int(flat[i]), 1) for i in np.flatnonzero(flat).tolist()] + [(0, 8, 9, 0)]
    df = spark.createDataFrame(runs, "s bigint, e bigint, label bigint, order int")
    n = volume.write_blocks(df, "label", "order", str(tmp_path / "v"), vol.shape, chunks)
    want = vol.copy()
    want[0, 0] = np.where(want[0, 0], want[0, 0], 9)
    got = np.zeros_like(vol)
    rows = volume.read_blocks(spark, str(tmp_path / "v"))
    for r in rows.collect():
        got[r.z, r.y, r.x] = r.value
    assert (got == want).all() and n > 0
    assert rows.filter("cz = 0").count() == (want[: chunks[0]] > 0).sum()
    plane = volume.slices(rows, "xz", 2)
    assert plane.count() == (want[:, 2] > 0).sum()
    assert volume.downsampled(volume.slices(rows, "xy"), 2).count() == (want[:, ::2, ::2] > 0).sum()


def test_tracker_json(spark, tmp_path):
    meta = spark.createDataFrame([(1, 1000, [4, 5, 6], "xy", True)], "class_id int, label_divisor bigint, shape3d array<int>, axis string, finished boolean")
    objects = spark.createDataFrame([(1, 1001, 0, 0, 0, 1, 1, 5, [0], [5]), (1, 1002, 2, 1, 0, 4, 3, 5, [66, 99], [2, 1])], "class_id int, label bigint, z1 int, y1 int, x1 int, z2 int, y2 int, x2 int, starts array<bigint>, runs array<bigint>")
    trackers.write_json(trackers.to_json_rows(objects, meta, ["class_id"]), str(tmp_path / "t"))
    got = trackers.read_json(spark, str(tmp_path / "t"))
    assert sorted(map(str, got.select(objects.columns).collect())) == sorted(map(str, objects.collect()))
    assert got.first().axis == "xy" and got.first().shape3d == [4, 5, 6]


def test_labelled_images(spark, tmp_path):
    for group, names in (("a", ["1.png", "2.png", "lone.png"]), ("b", ["1.png"])):
        for kind in ("images", "masks"):
            (tmp_path / group / kind).mkdir(parents=True)
            for n in names:
                if not (kind == "masks" and n == "lone.png"):
                    (tmp_path / group / kind / (n if kind == "images" else n.replace("png", "tiff"))).write_bytes(f"{group}{kind}{n}".encode())
    got = images.labelled_images(spark, str(tmp_path))
    assert {(r.subdir, r.name) for r in got.collect()} == {("a", "1"), ("a", "2"), ("b", "1")}
    w = {r.subdir: r.weight for r in got.collect()}
    assert w["b"] / w["a"] == pytest.approx(2**0.3) and sum(w.values()) == pytest.approx(1)
    twice = images.concat_datasets(got, got)
    assert twice.count() == 6


def test_views(spark):
    lab = np.zeros((8, 8), int)
    lab[2:5, 2:5] = 1
    px = spark.createDataFrame([(0, int(y), int(x), int(lab[y, x])) for y, x in np.ndindex(lab.shape)], "slice int, y int, x int, label int")
    one = images.instance_view(px, 8, 8, 1.0)
    assert one.count() == 64 and one.agg(F.sum("sem")).first()[0] == 9 and one.filter("y = 3 and x = 3").first().heat == 1.0
    assert images.contour_view(px).filter("cnt = 1 and sem = 0").count() > 0
    with pytest.raises(ValueError):
        images.panoptic_view(px.withColumnRenamed("label", "pan"), [1], [1], 10)


def test_config(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "root.json").write_text(json.dumps({"a": {"x": 1, "y": [1, 2]}, "b": 1}))
    (tmp_path / "sub" / "leaf.json").write_text(json.dumps({"BASE": "../root.json", "a": {"y": [3]}, "c": 2}))
    assert config.load(str(tmp_path / "sub" / "leaf.json")) == {"a": {"x": 1, "y": [3]}, "b": 1, "c": 2}
    (tmp_path / "loop.json").write_text(json.dumps({"BASE": "loop.json"}))
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "loop.json"))


def test_registry(spark):
    o = spark.createDataFrame([(1, 0, 0, 0, 9, 9, 9), (2, 0, 0, 0, 1, 9, 9), (3, 0, 0, 0, 9, 9, 9)], "node bigint, z1 int, y1 int, x1 int, z2 int, y2 int, x2 int")
    r = spark.createDataFrame([(1, 0, 90), (2, 0, 90), (3, 0, 5)], "node bigint, s bigint, e bigint")
    kept = registry.apply_filters(o, r, [{"name": "remove_small_objects", "min_size": 64}, {"name": "remove_pancakes", "min_span": 4}])
    assert [x.node for x in kept.collect()] == [1]
    with pytest.raises(ValueError):
        registry.apply_filters(o, r, [{"name": "none"}])
    registry.register(registry.MODELS, "double")(lambda by: lambda pdf: pdf.assign(y=pdf["node"] * by))
    assert [x.y for x in registry.infer(o.select("node"), "double", "node bigint, y bigint", by=2).orderBy("node").collect()] == [2, 4, 6]


def test_orthoplane(spark):
    """Two cuboids seen along three axes come back, under one label each."""
    vol = np.zeros((10, 11, 12), int)
    vol[1:8, 1:5, 1:6], vol[2:9, 6:10, 5:11] = 1, 2
    by_axis = {}
    for k, axis in enumerate(("xy", "xz", "yz")):
        rows = []
        for n in range(vol.shape[k]):
            plane = np.take(vol, n, k)
            rows += [(n, int(y), int(x), 1000 + int(plane[y, x])) for y, x in zip(*np.nonzero(plane))]
        px = spark.createDataFrame(rows, "slice int, y int, x int, pan bigint")
        by_axis[axis] = slice_objects(px, [], {"xy": 12, "xz": 12, "yz": 11}[axis], 1000)
    got = consensus_volume(by_axis, vol.shape, [1], 1000, filters=[{"name": "remove_small_objects", "min_size": 5}])
    out = np.zeros(vol.size, int)
    for r in got.collect():
        assert r.class_id == 1
        out[r.s : r.e] = r.instance
    assert (out.reshape(vol.shape) == vol).all()


def test_median_queue(spark):
    values = [1, 9, 2, 8, 3, 7, 4]
    df = spark.createDataFrame([("a", z, float(v)) for z, v in enumerate(values)] + [("b", 0, 5.0), ("b", 1, 6.0), ("c", 0, None)], "key string, slice bigint, value double")
    slide = {(r.key, r.slice): r.median for r in sliding_median(df, ["key"], ["slice"], "value", 3).collect()}
    assert [slide[("a", z)] for z in range(7)] == [1, 2, 8, 3, 7, 4, 4]
    rec = {(r.key, r.slice): r.median for r in recursive_median(df, ["key"], ["slice"], "value", 3).collect()}
    assert [rec[("a", z)] for z in range(7)] == [1, 2, 2, 3, 3, 4, 4] and rec[("b", 1)] == 6 and rec[("c", 0)] is None
    for n in range(12):
        for size in (1, 3, 5, 7):
            q = MedianQueue(size)
            out = [x for z in range(n) for x in q.push(z, float(z * 7 % 5))] + q.end()
            assert [z for z, _ in out] == list(range(n))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def stream(spark, df, folder, n):
    """The rows as a stream of n files, one for each micro-batch."""
    for k, part in enumerate(df.randomSplit([1.0] * n, seed=3)):
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_median_stream(rocks, tmp_path):
    values = [1, 9, 2, 8, 3, 7, 4]
    df = rocks.createDataFrame([(k, z, float(v), z == 6) for k in "ab" for z, v in enumerate(values)], "key string, slice bigint, value double, last boolean")
    got = {(r.key, r.slice): r.median for r in run(median_stream(stream(rocks, df, tmp_path / "in", 3)), tmp_path, "medians", "append").collect()}
    assert [got[("b", z)] for z in range(7)] == [1, 2, 2, 3, 3, 4, 4] and len(got) == 14


def test_period_stream(rocks, tmp_path):
    rows = [(1, [0, 20], [5, 5]), (1, [4], [3]), (1, [30, None], [1, 1]), (2, [7], [0]), (1, [7], [13]), (3, [1], [1])]
    df = rocks.createDataFrame(rows, "object_id bigint, starts array<bigint>, runs array<bigint>")
    run(period_stream(stream(rocks, df, tmp_path / "in", 3), "object_id"), tmp_path, "spans", "update")
    seen = {(r.entity, r.span_kind, r.first_idx, r.end_idx) for r in rocks.table("spans").collect()}
    assert {tuple(r) for r in periods_and_gaps(df, "object_id").collect()} <= seen


def test_match_stream(rocks, tmp_path):
    rows = [("s", 0, 5, [0], [9], False), ("s", 0, None, None, None, True), ("s", 1, 3, [1], [9], True), ("s", 2, None, None, None, True), ("s", 3, 4, [1], [9], True)]
    df = rocks.createDataFrame(rows, "stack string, slice bigint, label bigint, starts array<bigint>, runs array<bigint>, complete boolean")
    got = {r.slice: r.new_label for r in run(match_stream(stream(rocks, df, tmp_path / "in", 2), 1), tmp_path, "matches", "append").collect()}
    assert got == {0: 5, 1: 5, 3: 6}


def test_curation(spark):
    df = spark.createDataFrame([("a-ROI-b-LOC-xy_3_0-5_10-20",), ("q-LOC-2d-x",), ("plain",), (None,)], "n string")
    assert [r[0] for r in df.select(curate.dataset_name(F.col("n"))).collect()] == ["a", "q", "plain", None]
    p = spark.createDataFrame([("v-LOC-xz_12_0-5_10-20.tiff",), ("odd",)], "n string").select(curate.parse_location(F.col("n")).alias("p")).collect()
    assert tuple(p[0].p) == ("v", "xz", 12, 0, 5, 10, 20) and p[1].p.axis is None
    grid = curate.patch_grid(spark.createDataFrame([(1, 250, 90)], "id int, h int, w int"), "h", "w", 100).collect()
    assert {(r.y0, r.y1, r.x0, r.x1) for r in grid} == {(0, 100, 0, 90), (100, 200, 0, 90)}
    values = spark.createDataFrame([([float(i % 3) for i in range(6)],)], "v array<double>")
    assert values.select(curate.difference_hash(F.col("v"), 2)).first()[0] == 0b1111
    w = curate.weighted_sample(spark.createDataFrame([(i, 1.0 if i < 50 else 1000.0) for i in range(100)], "id int, w double"), "id", "w", 50)
    assert w.filter("id >= 50").count() > 40
    q = curate.quality_filter(spark.createDataFrame([(1, 0.9), (2, None), (3, 0.1)], "id int, p double"), F.col("p"), 0.5, "id", 0.0)
    assert [r.kept for r in q.orderBy("id").collect()] == [True, False, False]
    groups = curate.near_groups(spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "a bigint, b bigint"), Scratch(spark, "t"))
    assert {(r.id, r.group) for r in groups.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    with pytest.raises(ValueError):
        curate.flipbook_span(F.lit(1), 4, F.lit(9))


@pytest.mark.parametrize("codec", [None, "zlib", "gzip", "zstd"])
def test_chunked_array(spark, tmp_path, codec):
    import gzip
    import zlib

    import zstandard

    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[codec]
    vol = np.random.default_rng(2).integers(0, 4, (5, 6, 7)).astype("<u2")
    folder = tmp_path / "v" / "em" / "raw"
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps({"shape": vol.shape, "chunks": [2, 4, 3], "dtype": "<u2", "order": "C", "fill_value": 0, "compressor": codec and {"id": codec}, "filters": None}))
    whole = np.zeros((6, 8, 9), "<u2")
    whole[:5, :6, :7] = vol
    for cz, cy, cx in np.ndindex(3, 2, 3):
        block = whole[2 * cz : 2 * cz + 2, 4 * cy : 4 * cy + 4, 3 * cx : 3 * cx + 3]
        if block.any():
            (folder / f"{cz}.{cy}.{cx}").write_bytes(pack(block.tobytes()))
    got = np.zeros(vol.shape)
    rows = arrays.read_chunked(spark, f"{tmp_path}/v,em/raw")
    for r in rows.collect():
        got[r.z, r.y, r.x] = r.value
    assert (got == vol).all() and rows.filter("cz = 1").count() == (vol[2:4] > 0).sum()


def tiff(pages, order="<"):
    import struct

    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for p in pages:
        data_at = len(out)
        out += p.astype(p.dtype.newbyteorder(order)).tobytes()
        struct.pack_into(order + "I", out, link, len(out))
        tags = [(256, 4, p.shape[1]), (257, 4, p.shape[0]), (258, 3, 8 * p.dtype.itemsize), (259, 3, 1), (273, 4, data_at), (277, 3, 1), (279, 4, p.nbytes)]
        out += struct.pack(order + "H", len(tags))
        for tag, kind, v in tags:
            out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "I", v) if kind == 4 else struct.pack(order + "HH", v, 0))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(spark, tmp_path, order):
    pages = [np.random.default_rng(k).integers(0, 900, (4, 5)).astype(np.uint16) for k in range(3)]
    (tmp_path / "a.tiff").write_bytes(tiff(pages, order))
    got = np.zeros((3, 4, 5))
    for r in arrays.read_volumes(spark, f"{tmp_path}/*.tiff").collect():
        got[r.z, r.y, r.x] = r.value
    assert (got == np.stack(pages)).all()
    with pytest.raises(ValueError):
        formats.tiff_pages(b"no image at all")
    scaled = arrays.normalised(spark.createDataFrame([(1, 4.0), (1, 1.0), (2, 0.0)], "k int, value double"), ["k"])
    assert sorted(tuple(r) for r in scaled.collect()) == [(1, 63), (1, 255), (2, 0)]
    assert [arrays.smallest_type(n) for n in (255, 256, 65536, 2**32)] == ["uint8", "uint16", "uint32", "uint64"]


def test_fill_forms(spark, tmp_path):
    df = spark.createDataFrame([(0, 3, 1, 0), (2, 5, 2, 1)], "s bigint, e bigint, label bigint, order int")
    volume.fill(df, "label", "order", str(tmp_path / "p"), (1, 1, 6), form="parquet")
    assert {r.idx: r.label for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}
    volume.fill(df, "label", "order", str(tmp_path / "b"), (1, 1, 6), (1, 1, 4))
    assert volume.read_blocks(spark, str(tmp_path / "b")).count() == 5
    with pytest.raises(ValueError):
        volume.fill(df, "label", "order", "x", (1, 1, 6), form="other")
