"""A writer of TIFF files that fit a task, from a description of their layout."""

from __future__ import annotations

import struct
import zlib

import numpy as np

CODES = {"B": 1, "s": 2, "H": 3, "I": 4, "Q": 16, "f": 11, "d": 12}
FORMATS = {"u": 1, "i": 2, "f": 3}
ORIGIN = (300000.0, 4400000.0)


def pack_bits(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128))


def lzw(data: bytes) -> bytes:
    """Literal codes with a clear before each would outgrow nine bits."""
    bits = []
    emit = lambda code, n=9: bits.extend(code >> (n - 1 - k) & 1 for k in range(n))
    for k, byte in enumerate(data):
        if k % 200 == 0:
            emit(256)
        emit(byte)
    emit(257)
    return np.packbits(np.array(bits, np.uint8)).tobytes()


COMPRESS = {1: bytes, 5: lzw, 8: lambda d: zlib.compress(d), 32773: pack_bits}


def segments(data: np.ndarray, order: str, tile, rows, planar: int, compression: int, predictor: int) -> list[bytes]:
    """``data`` is (row, column, band)."""
    height, width, bands = data.shape
    planes = [data[:, :, [b]] for b in range(bands)] if planar == 2 else [data]
    out = []
    for plane in planes:
        if tile:
            tw, th = tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, plane.shape[2]), data.dtype)
            padded[:height, :width] = plane
            parts = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            parts = [plane[y : y + rows] for y in range(0, height, rows)]
        for part in parts:
            size = data.dtype.itemsize
            if predictor == 2:
                u = part.view(f"u{size}") if part.flags.c_contiguous else np.ascontiguousarray(part).view(f"u{size}")
                part = np.diff(u, axis=1, prepend=np.zeros_like(u[:, :1])).astype(u.dtype)
            if predictor == 3:
                n, w, s = part.shape
                big = np.ascontiguousarray(part).astype(f">f{size}").view(np.uint8).reshape(n, w * s, size)
                grouped = np.ascontiguousarray(big.transpose(0, 2, 1)).reshape(n, -1, s)
                raw = np.diff(grouped, axis=1, prepend=np.zeros_like(grouped[:, :1])).astype(np.uint8).tobytes()
            else:
                raw = np.ascontiguousarray(part).astype(part.dtype.newbyteorder(order)).tobytes()
            out.append(COMPRESS[compression](raw))
    return out


def tiff(data, *, order="<", big=False, tile=None, rows=None, planar=1, compression=1, predictor=1, scale=2.0, tie=ORIGIN, matrix=None, anchor=1, model=1, epsg=32654, unit=9001, nodata=None, gdal=None, geo=True, overviews=(), extra=(), drop=()) -> bytes:
    """The bytes of a file; ``extra`` are (tag, letter, values), ``drop`` tags that are left out."""
    word = "Q" if big else "I"
    head = struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16) if big else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8)
    body = bytearray(head)
    base = len(head)
    directories = []
    for level, image in enumerate([data, *overviews]):
        image = np.asarray(image)
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, bands = image.shape
        parts = segments(image, order, tile, rows or height, planar, compression, predictor)
        kind, size = FORMATS[image.dtype.kind], image.dtype.itemsize * 8
        tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [size] * bands), 259: ("H", [compression]), 277: ("H", [bands]), 284: ("H", [planar]), 339: ("H", [kind] * bands)}
        if predictor != 1:
            tags[317] = ("H", [predictor])
        if tile:
            tags |= {322: ("H", [tile[0]]), 323: ("H", [tile[1]]), 324: (word, parts), 325: (word, [len(p) for p in parts])}
        else:
            tags |= {278: ("I", [rows or height]), 273: (word, parts), 279: (word, [len(p) for p in parts])}
        if geo and not level:
            keys = [(1024, model), (1025, anchor), (3072 if model == 1 else 2048, epsg), *([(3076, unit)] if model == 1 else [])]
            keys = [(k, v) for k, v in keys if v]
            tags[34735] = ("H", [1, 1, 0, len(keys), *(n for k, v in keys for n in (k, 0, 1, v))])
            if scale:
                tags |= {33550: ("d", [scale, scale, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, tie[0], tie[1], 0.0])}
            if matrix:
                tags[34264] = ("d", matrix)
        if nodata is not None and not level:
            tags[42113] = ("s", nodata.encode() + b"\0")
        if gdal is not None and not level:
            tags[42112] = ("s", gdal.encode() + b"\0")
        for tag, letter, values in extra if not level else ():
            tags[tag] = (letter, values)
        directories.append({t: v for t, v in sorted(tags.items()) if t not in drop})
    counter, entry, tail = ("Q", 20, 8) if big else ("H", 12, 4)
    sizes = [struct.calcsize(f"={counter}") + entry * len(d) + tail for d in directories]
    at = base
    places = []
    for s in sizes:
        places.append(at)
        at += s
    blob = bytearray()
    start = at

    def keep(raw: bytes) -> int:
        blob.extend(raw)
        return start + len(blob) - len(raw)

    for k, d in enumerate(directories):
        d = dict(d)
        for tag in (273, 324):  # the parts of an image lie together
            if tag in d:
                d[tag] = (d[tag][0], [p if isinstance(p, int) else keep(p) for p in d[tag][1]])
        table = struct.pack(f"{order}{counter}", len(d))
        for tag, (letter, values) in d.items():
            raw = values if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
            room = 8 if big else 4
            slot = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(f"{order}{word}", keep(raw))
            table += struct.pack(f"{order}HH{word}", tag, CODES[letter], len(values)) + slot
        table += struct.pack(f"{order}{word}", places[k + 1] if k + 1 < len(places) else 0)
        body += table
    return bytes(body + blob)


def ramp(width: int, height: int, dtype="u2") -> np.ndarray:
    return np.arange(width * height).reshape(height, width).astype(dtype)
