import gzip
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanlattice.operators import curate
from spanlattice.plans.evaluate import evaluate_trackers
from spanlattice.sources import arrays, formats, images

RNG = np.random.default_rng(8)


def blosc_frame(data, width, block, shuffle, codec="lz4_raw", split=True):
    """A frame as the format's description has it, made the plain way."""
    out, starts = b"", []
    n_blocks = -(-len(data) // block)
    for k in range(n_blocks):
        piece = np.frombuffer(data[k * block : (k + 1) * block], np.uint8)
        items = len(piece) // width
        if shuffle == 4:
            items -= items % 8
            bits = np.unpackbits(piece[: items * width].reshape(items, width), axis=1, bitorder="little").T
            piece = np.concatenate([np.packbits(bits, axis=1, bitorder="little").reshape(-1), piece[items * width :]])
        elif shuffle:
            piece = np.concatenate([piece[: items * width].reshape(items, width).T.reshape(-1), piece[items * width :]])
        parts = np.split(piece, width) if split and len(piece) == block else [piece]
        starts.append(16 + 4 * n_blocks + len(out))
        for x in parts:
            raw = x.tobytes()
            small = pa.Codec(codec).compress(raw, asbytes=True) if codec == "lz4_raw" else zlib.compress(raw)
            small = raw if len(small) >= len(raw) else small
            out += struct.pack("<i", len(small)) + small
    flags = shuffle | (0 if split else 16) | ((1 if codec == "lz4_raw" else 3) << 5)
    return bytes([2, 1, flags, width]) + struct.pack("<III", len(data), block, 16 + 4 * n_blocks + len(out)) + b"".join(struct.pack("<I", x) for x in starts) + out


@pytest.mark.parametrize("shuffle", [0, 1, 4])
@pytest.mark.parametrize("codec", ["lz4_raw", "zlib"])
@pytest.mark.parametrize("split", [True, False])
def test_blosc(shuffle, codec, split):
    data = (RNG.integers(0, 300, 1003) // 7).astype("<u4").tobytes() + b"x"
    assert formats.blosc(blosc_frame(data, 4, 1024, shuffle, codec, split)) == data
    stored = bytes([2, 1, 2, 4]) + struct.pack("<III", len(data), 1024, 16 + len(data)) + data
    assert formats.blosc(stored) == data
    with pytest.raises(ValueError):
        formats.blosc(bytes([2, 1, 0, 4]) + struct.pack("<III", 8, 8, 20) + struct.pack("<I", 20))


@pytest.mark.parametrize("kind", ["blosc", "v3", "v3 transposed", "flat", "nested"])
def test_chunked_forms(spark, tmp_path, kind):
    shape, chunks = ((5, 6, 7), (2, 4, 3)) if kind != "flat" else ((6, 7), (4, 3))
    vol = RNG.integers(0, 4, shape).astype("<u2")
    fill = 0 if kind == "blosc" else 3
    grid = [-(-s // c) for s, c in zip(shape, chunks)]
    whole = np.full([g * c for g, c in zip(grid, chunks)], fill, "<u2")
    whole[tuple(map(slice, shape))] = vol
    new, sep = kind.startswith("v3"), "/" if kind in ("v3", "v3 transposed", "nested") else "."
    codecs = [{"name": "transpose", "configuration": {"order": [2, 0, 1]}}] * (kind == "v3 transposed") + [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}]
    meta = {"shape": shape, "fill_value": fill} | ({"data_type": "uint16", "chunk_grid": {"configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default"}, "codecs": codecs} if new else {"chunks": chunks, "dtype": "<u2", "compressor": {"id": "blosc"} if kind == "blosc" else None, "dimension_separator": sep})
    (tmp_path / ("zarr.json" if new else ".zarray")).write_text(json.dumps(meta))
    for at in np.ndindex(*grid):
        block = whole[tuple(slice(c * a, c * a + c) for a, c in zip(at, chunks))]
        if (block == fill).all() or at == (0,) * len(at) and kind == "nested":
            continue
        file = tmp_path / (("c/" if new else "") + sep.join(map(str, at)))
        file.parent.mkdir(parents=True, exist_ok=True)
        block = block.transpose(2, 0, 1) if kind == "v3 transposed" else block
        raw = np.ascontiguousarray(block).tobytes()
        file.write_bytes(blosc_frame(raw, 2, 48, 1, split=False) if kind == "blosc" else gzip.compress(raw) if new else raw)
    if kind == "nested":
        vol[:2, :4, :3] = fill
    got = np.full((1,) * (3 - len(shape)) + shape, fill)
    rows = arrays.read_chunked(spark, "file://" + str(tmp_path))
    for r in rows.collect():
        got[r.z, r.y, r.x] = r.value
    assert (got.reshape(shape) == vol).all()
    if kind != "flat":
        want = (vol != fill).nonzero()
        assert rows.filter("cz >= 1 and cy < 1").count() == ((want[0] >= 2) & (want[1] < 4)).sum()
        assert rows.filter("cx in (0, 2)").count() == (want[2] // 3 != 1).sum()


def tiff(page, codec, difference=1, tile=None):
    h, w = page.shape
    th, tw = tile or (3, w)
    pieces = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            part = page[y : y + th, x : x + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])))
            part = np.diff(part, axis=1, prepend=part.dtype.type(0)) if difference == 2 else part
            raw = np.ascontiguousarray(part).tobytes()
            if codec == 8:
                raw = zlib.compress(raw)
            elif codec == 32773:
                raw = b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100)) + bytes([128, 254, 0])[:1]
            elif codec == 5:
                bits = "".join(("100000000" if i % 200 == 0 else "") + f"{b:09b}" for i, b in enumerate(raw)) + "100000001"
                raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
            pieces.append(raw)
    out, at = bytearray(struct.pack("<2sHI", b"II", 42, 0)), []
    for p in pieces:
        at.append(len(out))
        out += p
    lists = len(out)
    out += struct.pack(f"<{len(at)}I", *at) + struct.pack(f"<{len(at)}I", *map(len, pieces))
    n = len(at)
    many = lambda tag, where, values: (tag, 4, n, where if n > 1 else values[0])
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8 * page.itemsize), (259, 3, 1, codec), (277, 3, 1, 1), (317, 3, 1, difference)]
    tags += [(322, 4, 1, tw), (323, 4, 1, th), many(324, lists, at), many(325, lists + 4 * n, [len(p) for p in pieces])] if tile else [many(273, lists, at), (278, 4, 1, th), many(279, lists + 4 * n, [len(p) for p in pieces])]
    struct.pack_into("<I", out, 4, len(out))
    out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + struct.pack("<I", 0)
    return bytes(out)


@pytest.mark.parametrize("codec", [1, 5, 8, 32773])
@pytest.mark.parametrize("difference, tile", [(1, None), (2, None), (2, (16, 16)), (1, (16, 16))])
def test_tiff_forms(codec, difference, tile):
    page = RNG.integers(0, 900, (20, 25)).astype("<u2")
    assert (formats.tiff_pages(tiff(page, codec, difference, tile))[0] == page).all()


def test_lzw_widths():
    """Codes of growing width, as an encoder makes them."""
    data = bytes(RNG.integers(0, 7, 9000).astype(np.uint8))
    table, word, bits, width = {bytes([i]): i for i in range(256)}, b"", f"{256:09b}", 9
    nxt = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        bits += f"{table[word]:0{width}b}"
        table[word + bytes([b])] = nxt
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
        word = bytes([b])
    bits += f"{table[word]:0{width}b}"
    assert formats.lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == data


def png(rows, w, bits, colour, rules, palette=b""):
    """Rows of bytes under the given filters."""
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, body, above = max(1, channels * bits // 8), b"", [0] * len(rows[0])
    for row, rule in zip(rows, rules):
        line = bytearray([rule])
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            e = a + b - c
            near = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
            line.append((v - {0: 0, 1: a, 2: b, 3: (a + b) // 2, 4: near}[rule]) & 255)
        body, above = body + bytes(line), row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, len(rows), bits, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png():
    grey = RNG.integers(0, 256, (10, 7))
    assert (formats.png(png(grey.tolist(), 7, 8, 0, [0, 1, 2, 3, 4] * 2)) == grey).all()
    colour = RNG.integers(0, 256, (6, 15))
    assert (formats.png(png(colour.tolist(), 5, 8, 2, [4, 3, 2, 1, 4, 3])) == colour.reshape(6, 5, 3)).all()
    deep = RNG.integers(0, 60000, (5, 4)).astype(">u2")
    assert (formats.png(png([list(r.tobytes()) for r in deep], 4, 16, 0, [1, 4, 3, 2, 0])) == deep).all()
    assert formats.png(png([[0b10110000], [0b01000000]], 4, 1, 0, [0, 2])).tolist() == [[1, 0, 1, 1], [0, 1, 0, 0]]
    assert formats.png(png([[1, 0]], 2, 8, 3, [0], bytes([1, 2, 3, 4, 5, 6]))).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    with pytest.raises(ValueError):
        formats.png(b"\xff\xd8\xff")


def test_volumes(spark, tmp_path):
    vol = RNG.integers(0, 500, (3, 4, 5)).astype("<i2")
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, 5, 4, 3, 1)
    head[208:212] = b"MAP "
    (tmp_path / "a.mrc").write_bytes(bytes(head) + vol.tobytes())
    (tmp_path / "b.nrrd").write_bytes(b"NRRD0004\ntype: short\ndimension: 3\nsizes: 5 4 3\nendian: little\nencoding: gzip\n\n" + gzip.compress(vol.tobytes()))
    nii = bytearray(352)
    struct.pack_into("<i", nii, 0, 348)
    struct.pack_into("<8h", nii, 40, 4, 5, 4, 3, 1, 1, 1, 1)
    struct.pack_into("<h", nii, 70, 4)
    struct.pack_into("<f", nii, 108, 352.0)
    nii[344:348] = b"n+1\0"
    (tmp_path / "c.nii.gz").write_bytes(gzip.compress(bytes(nii) + vol.tobytes()))
    (tmp_path / "d.png").write_bytes(png(vol[0].astype(np.uint8).tolist(), 5, 8, 0, [0, 1, 2, 3]))
    got = {}
    for r in arrays.read_volumes(spark, f"{tmp_path}/*").collect():
        got.setdefault(r.path[-3:], np.zeros((3, 4, 5)))[r.z, r.y, r.x] = r.value
    assert all((got[k] == vol).all() for k in ("mrc", "rrd", ".gz")) and (got["png"][0] == vol[0].astype(np.uint8)).all()
    for bad in (b"what", b"NRRD0004\ntype: block\nsizes: 2 2\nencoding: raw\n\n1234", bytes(head[:16]) + bytes(1008)):
        with pytest.raises(ValueError):
            formats.array_of(bad, "x.mrc" if bad[:4] != b"what" else "")


def test_decoded_images(spark, tmp_path):
    page = RNG.integers(0, 255, (4, 6))
    for kind, name, data in (("images", "1.png", png(page.tolist(), 6, 8, 0, [4, 3, 2, 1])), ("masks", "1.tiff", tiff(page.astype("<u2"), 8))):
        (tmp_path / "g" / kind).mkdir(parents=True)
        (tmp_path / "g" / kind / name).write_bytes(data)
    pairs = images.labelled_images(spark, str(tmp_path))
    for column in ("image", "mask"):
        got = images.decoded(pairs, column).collect()
        assert len(got) == 24 and all((r.h, r.w, r.value) == (4, 6, page[r.y, r.x]) for r in got)


def test_evaluate_trackers(spark):
    schema = "class_id int, label bigint, starts array<bigint>, runs array<bigint>"
    gt = spark.createDataFrame([(1, 5, [0, 20], [10, 10]), (1, 6, [50], [10])], schema)
    pred = spark.createDataFrame([(1, 9, [0, 20, None], [10, 10, 3]), (1, 8, [55], [10])], schema)
    r = evaluate_trackers(gt, pred).first()
    assert (r.precision_50, r.recall_50, r.f1_75) == (0.5, 0.5, 0.5) and r.semantic_iou == pytest.approx(25 / 35)
    with pytest.raises(ValueError):
        evaluate_trackers(gt, pred.selectExpr("2 as class_id", "label", "starts", "runs"))


def test_image_hashes(spark):
    from pyspark.sql import functions as F

    big, small = RNG.integers(0, 65536, (20, 30)), RNG.integers(0, 256, (3, 4))
    rows = [(1, big.astype("<u2").tobytes(), "uint16", 20, 30), (2, small.astype("u1").tobytes(), "uint8", 3, 4), (3, b"1", "uint8", 3, 4), (4, None, "uint8", 3, 4), (None, b"1", "uint8", 1, 1), (5, b"1", "other", 1, 1), (6, b"", "uint8", 0, 4)]
    df = spark.createDataFrame(rows, "id bigint, image binary, dtype string, h int, w int")
    got = {r.id: r["values"] for r in curate.pooled_means(df, "id", "image", "dtype", F.col("h"), F.col("w")).collect()}
    own = {(y * 8 // 3, x * 9 // 4): float(small[y, x]) for y in range(3) for x in range(4)}
    assert set(got) == {1, 2} and got[2] == [own.get((r, c), float(small[r * 3 // 8, c * 4 // 9])) for r in range(8) for c in range(9)]
    assert got[1] == pytest.approx([big[[y for y in range(20) if y * 8 // 20 == r]][:, [x for x in range(30) if x * 9 // 30 == c]].mean() for r in range(8) for c in range(9)])
    pairs = spark.createDataFrame([(1, 1, 0, "a"), (2, 2, 1, "a"), (3, 3, 1, "b"), (4, 4, 3, "b")], "id bigint, class_id bigint, h bigint, dataset string")
    assert {tuple(r) for r in curate.hash_pairs(pairs, 1, 64, 2, "dataset").collect()} == {(1, 2, 1), (3, 4, 1)}
