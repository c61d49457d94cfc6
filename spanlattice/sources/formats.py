"""Bytes of image and volume files to arrays: TIFF, PNG, MRC, NRRD, NIfTI-1, and the codecs of chunked arrays.

Written from the formats' public descriptions, with what the standard library, numpy, pyarrow and zstandard offer. Whatever is
not covered (JPEG, lossy or exotic compressions, interlaced PNG) is an error that says so, never a wrong array.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np

# --- codecs


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _arrow(codec: str):
    def decode(data: bytes, size: int) -> bytes:
        import pyarrow as pa

        return pa.Codec(codec).decompress(data, size).to_pybytes()

    return decode


#: Codecs of a Blosc frame, by the number in the top three bits of its flags; number 0 (its own codec) is not read.
_IN_BLOSC = {1: _arrow("lz4_raw"), 2: _arrow("snappy"), 3: lambda b, n: zlib.decompress(b), 4: lambda b, n: _zstd(b)}
_SHUFFLED, _STORED, _BITS, _WHOLE = 1, 2, 4, 16


def blosc(data: bytes) -> bytes:
    """The content of a Blosc (version 1) frame: blocks, split by byte of the element, shuffled by bytes or bits."""
    _, _, flags, width = data[:4]
    size, block, _ = struct.unpack("<III", data[4:16])
    if flags & _STORED:
        return data[16 : 16 + size]
    decode = _IN_BLOSC.get(flags >> 5)
    if decode is None:
        raise ValueError("this codec of a Blosc frame is not supported")
    starts = struct.unpack(f"<{-(-size // block)}I", data[16 : 16 + 4 * -(-size // block)])
    out = []
    for k, at in enumerate(starts):
        n = min(block, size - k * block)
        split = not flags & _WHOLE and 1 < width <= 16 and block // width >= 128 and n == block
        parts = []
        for _ in range(width if split else 1):
            (m,) = struct.unpack("<i", data[at : at + 4])
            piece, wanted = data[at + 4 : at + 4 + m], n // width if split else n
            parts.append(piece if m == wanted else decode(piece, wanted))
            at += 4 + m
        raw = np.frombuffer(b"".join(parts), np.uint8)
        items = n // width
        if flags & _BITS and width:
            items -= items % 8  # the rest is left as it is
            bits = np.unpackbits(raw[: items * width].reshape(8 * width, -1), axis=1, bitorder="little")
            raw = np.concatenate([np.packbits(bits.T, axis=1, bitorder="little").reshape(-1), raw[items * width :]])
        elif flags & _SHUFFLED and width > 1:
            raw = np.concatenate([raw[: items * width].reshape(width, items).T.reshape(-1), raw[items * width :]])
        out.append(raw.tobytes())
    return b"".join(out)


CODECS = {None: lambda b: b, "zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": _zstd, "blosc": blosc, "crc32c": lambda b: b[:-4]}


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """LZW of TIFF: codes of 9 to 12 bits, the highest bit first; 256 clears the table and 257 ends."""
    out, bits, held, width = bytearray(), 0, 0, 9
    entries: list[bytes] = []
    last = None
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            entries, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        word = entries[code] if code < len(entries) else last + last[:1]
        out += word
        if last is not None:
            entries.append(last + word[:1])
        last = word
        width = 12 if len(entries) >= 2047 else 11 if len(entries) >= 1023 else 10 if len(entries) >= 511 else 9
    return bytes(out)


# --- TIFF

_TIFF_CODECS = {1: lambda b: b, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits}


def tiff_pages(data: bytes) -> list[np.ndarray]:
    """The pages of a grey TIFF of 8, 16, 32 or 64 bits a pixel, in strips or tiles; plain, LZW, deflate or PackBits, with or without differences."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    sizes = {1: "B", 3: "H", 4: "I"}
    at, pages = struct.unpack(order + "I", data[4:8])[0], []
    while at:
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            if kind in sizes:
                form = f"{order}{count}{sizes[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    where = struct.unpack(order + "I", data[where : where + 4])[0]
                tags[tag] = struct.unpack(form, data[where : where + struct.calcsize(form)])
        codec, difference, bits = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(258, (1,))[0]
        if codec not in _TIFF_CODECS or tags.get(277, (1,))[0] != 1 or bits not in (8, 16, 32, 64) or difference not in (1, 2):
            raise ValueError("only grey pages, plain or losslessly compressed, are read")
        kind = np.dtype(f"{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(339, (1,))[0]] }{bits // 8}").newbyteorder(order)
        (w,), (h,) = tags[256], tags[257]
        tiled = 324 in tags
        th, tw = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (h,))[0], h), w)
        page = np.zeros((h, w), kind.newbyteorder("="))
        across = -(-w // tw)
        for k, (a, m) in enumerate(zip(*((tags[324], tags[325]) if tiled else (tags[273], tags[279])))):
            y, x = k // across * th, k % across * tw
            rows = th if tiled else min(th, h - y)
            piece = np.frombuffer(_TIFF_CODECS[codec](data[a : a + m]), kind)[: rows * tw].reshape(rows, tw).astype(page.dtype)
            if difference == 2:
                piece = np.cumsum(piece, axis=1, dtype=page.dtype)
            page[y : y + th, x : x + tw] = piece[: h - y, : w - x]
        pages.append(page)
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return pages


# --- PNG


def png(data: bytes) -> np.ndarray:
    """Array (h, w), or (h, w, channels) of a colour or alpha image; palettes are looked up. Not interlaced, 1 to 16 bits."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    if interlaced:
        raise ValueError("interlaced images are not read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, line = max(1, channels * bits // 8), -(-w * channels * bits // 8)
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, line + 1)
    rows, above = np.zeros((h, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(h):
        rule, now = raw[y, 0], raw[y, 1:].copy()
        if rule == 1:
            pad = np.zeros(-(-line // step) * step, np.uint8)
            pad[:line] = now
            now = np.cumsum(pad.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:line]
        elif rule == 2:
            now = now + above
        elif rule in (3, 4):  # each byte needs the one before
            b, left = above.tolist(), [0] * step
            c = [0] * step + b
            got = left[:]
            for i, v in enumerate(now.tolist()):
                p, q, r = got[i], b[i], c[i]
                if rule == 3:
                    v += (p + q) // 2
                else:
                    e = p + q - r
                    v += min((abs(e - p), 0, p), (abs(e - q), 1, q), (abs(e - r), 2, r))[2]
                got.append(v & 255)
            now = np.array(got[step:], np.uint8)
        rows[y] = above = now
    if bits == 16:
        out = rows.view(">u2").astype(np.uint16)
    elif bits == 8:
        out = rows
    else:
        parts = np.unpackbits(rows, axis=1).reshape(h, -1, bits)
        out = (parts * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :w]
    if palette is not None and colour == 3:
        return palette[out[:, :w]]
    return out.reshape(h, w, channels) if channels > 1 else out.reshape(h, w)


# --- volumes

_MRC = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}
_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_NRRD = {"uchar": "u1", "uint8": "u1", "unsigned char": "u1", "uint8_t": "u1", "char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "unsigned short": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8"}


def mrc(data: bytes) -> np.ndarray:
    order = ">" if data[212:213] == b"\x11" else "<"
    nx, ny, nz, mode = struct.unpack(order + "4i", data[:16])
    (extra,) = struct.unpack(order + "i", data[92:96])
    if mode not in _MRC or min(nx, ny, nz) < 1:
        raise ValueError(f"mode {mode} of an MRC file of {nx} x {ny} x {nz} is not read")
    return np.frombuffer(data, np.dtype(order + _MRC[mode]), nx * ny * nz, 1024 + extra).reshape(nz, ny, nx)


def nifti(data: bytes) -> np.ndarray:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dim, (kind,), (offset,) = struct.unpack(order + "8h", data[40:56]), struct.unpack(order + "h", data[70:72]), struct.unpack(order + "f", data[108:112])
    shape = [n for n in dim[1 : 1 + dim[0]]]
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    if kind not in _NIFTI or len(shape) > 3 or min(shape) < 1:
        raise ValueError(f"type {kind} or shape {shape} of a NIfTI file is not read")
    shape += [1] * (3 - len(shape))
    return np.frombuffer(data, np.dtype(order + _NIFTI[kind]), int(np.prod(shape)), int(offset)).reshape(shape[::-1])  # x runs fastest


def nrrd(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"\n\n")
    fields = dict(x.split(": ", 1) for x in head.decode("ascii", "replace").split("\n")[1:] if ": " in x and not x.startswith("#"))
    shape, kind, encoding = [int(n) for n in fields["sizes"].split()], fields["type"].strip(), fields["encoding"].strip()
    if kind not in _NRRD or len(shape) > 3 or min(shape) < 1 or "data file" in fields or encoding not in ("raw", "gzip", "gz"):
        raise ValueError(f"type {kind}, encoding {encoding} or shape {shape} of an NRRD file is not read")
    order = ">" if fields.get("endian", "little").strip() == "big" else "<"
    raw = body if encoding == "raw" else gzip.decompress(body)
    shape += [1] * (3 - len(shape))
    return np.frombuffer(raw, np.dtype(order + _NRRD[kind]), int(np.prod(shape))).reshape(shape[::-1])


def array_of(data: bytes, name: str = "") -> np.ndarray:
    """The array of a file, (z, y, x) with one slice for a 2D image: by its first bytes, for MRC and NIfTI by its ending or mark."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        pages = tiff_pages(data)
        if len({p.shape for p in pages}) != 1:
            raise ValueError("the pages of the TIFF differ in size")
        return np.stack(pages)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        out = png(data)
        if out.ndim != 2:
            raise ValueError("only grey images are volumes")
        return out[None]
    if data[:4] == b"NRRD":
        return nrrd(data)
    if name.endswith((".nii", ".nii.gz")) or data[344:348] in (b"n+1\0", b"ni1\0"):
        return nifti(data)
    if data[208:212] == b"MAP " or name.endswith((".mrc", ".rec")):
        return mrc(data)
    raise ValueError(f"the format of {name or 'the file'} is not known")
