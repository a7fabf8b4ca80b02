"""Segment codecs and predictors."""

from __future__ import annotations

import zlib

import numpy as np

from sparkgrid.diagnostics import Code, RasterError

#: Compression schemes of the tag.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def unpack_bits(data: bytes, size: int) -> bytes:
    """Runs and literals, each after a count byte."""
    out = bytearray()
    at = 0
    while at < len(data) and len(out) < size:
        count = data[at]
        if count < 128:
            out += data[at + 1 : at + 2 + count]
            at += 2 + count
        else:
            if count > 128:
                out += data[at + 1 : at + 2] * (257 - count)
            at += 2 if count > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    clear, end = 256, 257
    words: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    out = bytearray()
    bits, held, at, width = 0, 0, 0, 9
    before = b""
    while len(out) < size:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits, held, at = (bits << 8) | data[at], held + 8, at + 1
        code = bits >> (held - width) & ((1 << width) - 1)
        held -= width
        bits &= (1 << held) - 1
        if code == end:
            break
        if code == clear:
            del words[258:]
            width, before = 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and before:
            word = before + before[:1]
        else:
            raise RasterError(Code.TruncatedData, "an LZW code is out of range")
        out += word
        if before:
            words.append(before + word[:1])
        before = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def decompress(data: bytes, compression: int, size: int) -> bytes:
    """A segment's bytes; fewer than its layout needs is an error."""
    if compression == NONE:
        out = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as error:
            raise RasterError(Code.TruncatedData, "a deflated segment is damaged") from error
    elif compression == LZW:
        out = unpack_lzw(data, size)
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise RasterError(Code.UnsupportedCompression, f"unsupported compression {compression}")
    if len(out) < size:
        raise RasterError(Code.TruncatedData, "a segment decodes to too few bytes")
    return out[:size]


def undo_differences(rows: np.ndarray) -> np.ndarray:
    """Predictor 2: each sample is stored less the one before; (row, pixel, band) of unsigned integers."""
    return np.cumsum(rows, axis=1, dtype=rows.dtype)


def undo_float_planes(rows: np.ndarray, samples: int, width: int, size: int) -> np.ndarray:
    """Predictor 3: bytes are differenced, and grouped by significance, across a row.

    ``rows`` are bytes (row, width * samples * size); the result is big-endian.
    """
    count = rows.shape[0]
    sums = np.cumsum(rows.reshape(count, -1, samples), axis=1, dtype=np.uint8).reshape(count, -1)
    return np.ascontiguousarray(sums.reshape(count, size, width * samples).transpose(0, 2, 1))
