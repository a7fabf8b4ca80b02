"""FLAC: bytes stored losslessly as 8-bit mono samples, and read back as PCM blocks.

The coder writes fixed predictors of order 0 to 2 or a linear predictor fitted to
the frame, with Rice residuals, or the samples verbatim where that is shorter, and
one seek point for each frame.  Streams and the PCM blocks decoded from them are
tables in the shared folder; a block's first sample makes it findable.  The
decoder takes constant, verbatim, fixed and linear subframes with any Rice
partitioning or escape, and verifies the frame header's CRC-8, the frame's CRC-16
and the stream's MD5.  The frames of a slice of rows are coded and decoded side by
side: a numpy step handles the next sample of all.

Letters are no waveform, so a text's stream bears a palette in an application
block: the commoner a byte is in the text, the nearer to 0 is its sample.  The
decoder undoes it, so PCM blocks hold the bytes less 128 either way.

Defined results: a null or empty text is 64 zero bytes; any byte is legal, so
length bounds memory only by one text; equal texts give equal streams; columns
of the input other than the id and the text are ignored; rows that repeat an id
each give their row; an empty table gives none.  A stream that fails a checksum
raises ``FlacError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.llm.arrowtext import bounds, slices
from sparkgrid.scratch import discard, stored

BLOCK = 1024
#: Frames that are coded side by side, but for those of one text.
FRAMES = 2048
RATE = 8000
PAD = 64
#: Order of the linear predictors that are fitted, and bits of a weight.
ORDER, PRECISION = 4, 15
U64 = np.uint64
#: Name of the application block with the palette.
PALETTE = b"rank"
#: How the stored tables are written: more effort, and pages in which more texts meet.
TIGHT = {"parquet.compression.codec.zstd.level": 12, "parquet.page.size": 8 << 20}
#: The byte that stands for the r-th commonest one: that of the sample 0, -1, 1, -2, and so on.
BY_RANK = np.array([(r >> 1 ^ -(r & 1)) + 128 for r in range(256)], np.uint8)
#: Block sizes by their four-bit code in a frame header; 6 and 7 follow the header.
SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
CODES = {size: code for code, size in SIZES.items()}


class FlacError(ValueError):
    """A stream that is damaged or not of the kind read here."""


def crc_table(polynomial: int, width: int) -> list[int]:
    """Table of the CRC with that polynomial, most significant bit first."""
    out = []
    for byte in range(256):
        value = byte << (width - 8)
        for _ in range(8):
            value = (value << 1) ^ (polynomial if value >> (width - 1) & 1 else 0)
        out.append(value & ((1 << width) - 1))
    return out


CRC8, CRC16 = crc_table(0x07, 8), np.array(crc_table(0x8005, 16), np.uint16)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = CRC8[value ^ byte]
    return value


def crc16(frames: list[bytes]) -> np.ndarray:
    """CRC-16 of each of many byte strings, side by side.

    The CRC starts at 0, so zeros before a string leave it alone: the strings are
    aligned at their ends.
    """
    longest = max(map(len, frames), default=0)
    grid = np.zeros((len(frames), longest), np.uint8)
    for row, frame in zip(grid, frames, strict=True):
        row[longest - len(frame) :] = np.frombuffer(frame, np.uint8)
    value = np.zeros(len(frames), np.uint16)
    for column in np.ascontiguousarray(grid.T):
        value = CRC16[(value >> 8) ^ column] ^ (value << 8)
    return value


def coded_number(n: int) -> bytes:
    """A frame number in the variable-length code of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(~room << 1) & 0xFF | n, *reversed(tail)])


@lru_cache(1 << 16)
def frame_header(number: int, size: int) -> bytes:
    code = CODES.get(size, 7)
    head = b"\xff\xf8" + bytes([code << 4, 1 << 1]) + coded_number(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    return head + bytes([crc8(head)])


def _differences(samples: np.ndarray, order: int) -> np.ndarray:
    """Residuals of the fixed predictor of an order."""
    for _ in range(order):
        samples = np.diff(samples, axis=1, prepend=0)
    return samples


def linear_predictors(samples: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each row of samples the weights of a linear predictor, as whole numbers, and their shift.

    The autocorrelation is a sum of integers and all that follows goes element by
    element, so a row's predictor does not depend on the rows beside it.
    """
    wide = samples.astype(np.int64)
    lags = [(wide[:, : wide.shape[1] - k] * wide[:, k:]).sum(axis=1).astype(np.float64) for k in range(order + 1)]
    error = lags[0] * (1 + 2.0**-30) + 2.0**-30
    weights: list[np.ndarray] = []
    for k in range(order):  # Levinson and Durbin's recursion
        reflection = lags[k + 1].copy()
        for j, w in enumerate(weights):
            reflection -= w * lags[k - j]
        reflection /= error
        weights = [w - reflection * weights[k - 1 - j] for j, w in enumerate(weights)] + [reflection]
        error = np.maximum(error * (1 - reflection * reflection), 2.0**-30)
    table = np.stack(weights, axis=1)
    largest = np.abs(table).max(axis=1)
    shift = np.clip(PRECISION - 1 - np.frexp(largest)[1], 0, 15)
    limit = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(table * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _predicted_from(samples: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals of each row's linear predictor."""
    guess = np.zeros(samples.shape, np.int64)
    for j in range(weights.shape[1]):
        guess[:, j + 1 :] += weights[:, j : j + 1] * samples[:, : -(j + 1)]
    return samples - (guess >> shift[:, None])


def _zigzag(residuals: np.ndarray, inside: np.ndarray, order: int) -> np.ndarray:
    """Residuals as non-negative numbers, 0 at warm-up and padding."""
    z = ((residuals << 1) ^ (residuals >> 31)).astype(np.int32)
    z[~inside] = 0
    z[:, :order] = 0
    return z


def ranked(data: bytes) -> tuple[bytes, bytes]:
    """The bytes with the commonest nearest to the sample 0, and the palette that undoes it: those that occur, by falling count."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    palette = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint8)
    table = np.zeros(256, np.uint8)
    table[palette] = BY_RANK[: len(palette)]
    return data.translate(table.tobytes()), palette.tobytes()


def encode(payloads: list[bytes], coefficients: tuple[int, ...] | None = None, shift: int = 0, palettes: list[bytes] | None = None, block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes less 128 are the samples; ``palettes`` are kept with them.

    Each frame has the shortest of its fixed predictors of order 0 to 2, the linear
    predictor fitted to it, and its samples verbatim; ``coefficients`` with
    ``shift`` leave only that linear predictor or verbatim.
    """
    sizes: list[int] = []
    owner: list[int] = []
    for i, p in enumerate(payloads):
        for at in range(0, len(p), block):
            sizes.append(min(block, len(p) - at))
            owner.append(i)
    if len(sizes) > FRAMES and len(payloads) > 1:
        half = len(payloads) // 2
        parts = (slice(0, half), slice(half, None))
        return [m for s in parts for m in encode(payloads[s], coefficients, shift, palettes and palettes[s], block)]
    count = np.array(sizes, np.int64)
    width = max(sizes, default=PAD)
    grid = np.zeros((len(sizes), width), np.int32)
    inside = np.arange(width)[None, :] < count[:, None]
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    grid[inside] = raw.astype(np.int32) - 128
    best = (count * 8).astype(np.int64)  # verbatim
    chosen_kind, k_of = np.full(len(sizes), -1), np.zeros(len(sizes), np.int32)
    #: Order, residuals, and for linear predictors each frame's weights and shift.
    if coefficients is None:
        kinds = [(order, _zigzag(_differences(grid, order), inside, order), None, None) for order in range(3)]
        weights, shifts = linear_predictors(grid)
    else:
        kinds = []
        weights, shifts = np.tile(np.array(coefficients, np.int64), (len(sizes), 1)), np.full(len(sizes), shift)
    order = weights.shape[1]
    kinds.append((order, _zigzag(_predicted_from(grid, weights, shifts), inside, order), weights, shifts))
    for n, (order, z, weights, _) in enumerate(kinds):
        left = np.maximum(count - order, 1)
        base = np.frexp(z.sum(axis=1, dtype=np.int64) / left)[1] - 1
        for k in (np.clip(base - 1, 0, 14).astype(np.int32), np.clip(base, 0, 14).astype(np.int32)):
            cost = (z >> k[:, None]).sum(axis=1, dtype=np.int64) + left * (1 + k) + 8 * order + 10
            if weights is not None:
                cost += 9 + PRECISION * order
            good = (cost < best) & (count > order)
            best[good], chosen_kind[good], k_of[good] = cost[good], n, k[good]
    regions: list[bytes] = [b""] * len(sizes)
    for n, (order, z, weights, shifts) in enumerate(kinds):
        chosen = np.flatnonzero(chosen_kind == n)
        if not len(chosen):
            continue
        k = k_of[chosen]
        used = inside[chosen]
        used[:, :order] = False
        z = z[chosen]
        head = 10 if weights is None else 10 + 9 + PRECISION * order
        lengths = np.where(used, (z >> k[:, None]) + 1 + k[:, None], 0)
        ends = np.cumsum(lengths, axis=1) + head
        room = -(-ends[:, -1] // 8)
        first = np.concatenate([[0], np.cumsum(room)])
        bits = np.zeros(int(first[-1]) * 8, np.uint8)
        start = first[:-1] * 8
        field = np.zeros((len(chosen), head), np.uint8)
        if weights is not None:
            field[:, :4] = [(PRECISION - 1) >> b & 1 for b in (3, 2, 1, 0)]
            field[:, 4:9] = shifts[chosen, None] >> np.arange(4, -1, -1) & 1
            field[:, 9 : 9 + PRECISION * order] = (weights[chosen][:, :, None] >> np.arange(PRECISION - 1, -1, -1) & 1).reshape(len(chosen), -1)
        for b in range(4):
            field[:, head - 1 - b] = k >> b & 1
        bits[start[:, None] + np.arange(head)] = field
        last = (ends + start[:, None] - 1)[used]
        width = np.broadcast_to(k[:, None], used.shape)[used]
        value = (1 << width) | (z[used] & ((1 << width) - 1))
        for b in range(int(k.max()) + 1):
            here = width >= b
            bits[last[here] - b] = (value[here] >> b) & 1
        packed = np.packbits(bits).tobytes()
        kind = 0x10 | order << 1 if weights is None else 0x40 | (order - 1) << 1
        for j, f in enumerate(chosen.tolist()):
            warm = ((grid[f, :order]).astype(np.int8)).tobytes()
            regions[f] = bytes([kind]) + warm + packed[first[j] : first[j + 1]]
    frames: list[bytes] = []
    numbers = []
    previous, number, at = -1, 0, 0
    for f, (i, size) in enumerate(zip(owner, sizes, strict=True)):
        number = number + 1 if i == previous else 0
        previous = i
        body = regions[f] or b"\x02" + (raw[at : at + size] ^ 0x80).tobytes()
        at += size
        frames.append(frame_header(number, size) + body)
        numbers.append(number)
    sums = crc16(frames).astype(">u2").tobytes()
    out, f = [], 0
    for i, p in enumerate(payloads):
        seek, whole, offset, lengths_ = [], [], 0, []
        while f < len(frames) and owner[f] == i:
            whole.append(frames[f] + sums[2 * f : 2 * f + 2])
            seek.append(struct.pack(">QQH", numbers[f] * block, offset, sizes[f]))
            offset += len(whole[-1])
            lengths_.append(len(whole[-1]))
            f += 1
        tail = (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        digest = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", block, block) + min(lengths_, default=0).to_bytes(3, "big") + max(lengths_, default=0).to_bytes(3, "big") + tail + digest
        points = b"".join(seek)
        colours = b"" if palettes is None else b"\x02" + (len(PALETTE) + len(palettes[i])).to_bytes(3, "big") + PALETTE + palettes[i]
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + colours + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(whole))
    return out


@lru_cache(1 << 16)
def _parse_header(head: bytes) -> tuple[int, int]:
    """Length of the frame header at the start of ``head`` and the block size it states."""
    if head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise FlacError("no frame at a seek point")
    if head[3] >> 4 or (head[3] >> 1 & 7) not in (0, 1):
        raise FlacError("not 8-bit mono")
    at, lead = 5, head[4]
    if lead >= 0xC0:
        at += 8 - (lead ^ 0xFF).bit_length() - 1
    code = head[2] >> 4
    if code == 6:
        size, at = head[at] + 1, at + 1
    elif code == 7:
        size, at = struct.unpack_from(">H", head, at)[0] + 1, at + 2
    else:
        size = SIZES[code]
    at += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    if crc8(head[:at]) != head[at]:
        raise FlacError("a frame header fails its CRC-8")
    return at + 1, size


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame as signed bytes; checksums verified."""
    if not frames:
        return []
    if crc16(frames).any():  # a string followed by its own CRC has the CRC 0
        raise FlacError("a frame fails its CRC-16")
    heads = [_parse_header(f[:16]) for f in frames]
    out: list[np.ndarray | None] = [None] * len(frames)
    riced = []
    for i, (f, (at, size)) in enumerate(zip(frames, heads, strict=True)):
        kind = f[at] >> 1
        if f[at] & 0x81:
            raise FlacError("a subframe of an unknown kind")
        if kind == 0:
            out[i] = np.full(size, f[at + 1], np.uint8).view(np.int8)
        elif kind == 1:
            out[i] = np.frombuffer(f, np.int8, size, at + 1)
        elif 8 <= kind <= 12:
            riced.append((size - (kind - 8), i, kind - 8, at + 1, size, False))
        elif kind >= 32:
            riced.append((size - (kind - 31), i, kind - 31, at + 1, size, True))
        else:
            raise FlacError("a subframe of an unknown kind")
    if riced:
        riced.sort(reverse=True)
        for (_, i, *_), samples in zip(riced, _decode_riced(frames, riced), strict=True):
            out[i] = samples
    return out  # type: ignore[return-value]


_ZEROS = np.full(1 << 16, 16, np.uint8)
for _n in range(16):
    _ZEROS[1 << _n : 2 << _n] = 15 - _n


def _decode_riced(frames: list[bytes], riced: list[tuple]) -> list[np.ndarray]:
    """Fixed and linear subframes, side by side, those with most residuals first."""
    n = len(riced)
    data = np.frombuffer(b"".join(frames[i] for _, i, *_ in riced) + bytes(16), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(frames[i]) for _, i, *_ in riced])])[:-1]
    words = np.ndarray((len(data) - 8,), ">u8", buffer=data, strides=(1,))

    def peek(position: np.ndarray) -> np.ndarray:
        """57 bits or more from each bit position, at the top of 64."""
        return words[position >> 3].astype(U64) << (position & 7).astype(U64)

    def bits(position: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.asarray(width)
        return ((peek(position) >> U64(1)) >> (U64(63) - width.astype(U64))).astype(np.int64)

    order = np.array([r[2] for r in riced])
    size = np.array([r[4] for r in riced])
    linear = np.array([r[5] for r in riced])
    at = (base + np.array([r[3] for r in riced])) * 8
    warm = np.zeros((n, int(order.max())), np.int64)
    for j in range(warm.shape[1]):
        here = order > j
        warm[here, j] = bits(at[here], 8).astype(np.int8)
        at[here] += 8
    weights = np.zeros((n, 32), np.int64)
    shift = np.zeros(n, np.int64)
    if linear.any():
        precision = np.where(linear, bits(at, 4) + 1, 0)
        shift[linear] = bits(at[linear] + 4, 5)
        at[linear] += 9
        for j in range(int(order[linear].max())):
            here = linear & (order > j)
            value = bits(at[here], precision[here])
            weights[here, j] = value - ((value >> (precision[here] - 1)) << precision[here])
            at[here] += precision[here]
    for r, row in enumerate(FIXED):
        weights[~linear & (order == r), : len(row)] = row
    wide = bits(at, 2)
    if (wide > 1).any():
        raise FlacError("residuals of an unknown coding")
    parts = bits(at + 2, 4)
    at += 6
    left = size - order
    span = size >> parts
    turn = span - order  # residuals up to the next parameter
    fresh = np.ones(n, bool)
    k = np.zeros(n, np.int64)
    escape = np.zeros(n, bool)
    zigzag = np.zeros((int(left[0]), n), np.int64)
    active = n
    any_escape = False
    for r in range(int(left[0])):
        while left[active - 1] <= r:
            active -= 1
        due = np.flatnonzero(fresh[:active]) if r == 0 else np.flatnonzero(turn[:active] == r)
        while len(due):
            k[due] = bits(at[due], 4 + wide[due])
            at[due] += 4 + wide[due]
            escape[due] = k[due] == np.where(wide[due] == 1, 31, 15)
            raw = due[escape[due]]
            k[raw] = bits(at[raw], 5)
            at[raw] += 5
            any_escape = bool(escape.any())
            if r:
                turn[due] += span[due]
            due = due[turn[due] == r]  # a first part may be all warm-up
        p = at[:active]
        view = peek(p)
        zeros = _ZEROS[(view >> U64(48)).astype(np.int64)].astype(np.int64)
        kk = k[:active]
        if zeros.max(initial=0) == 16 or any_escape:
            zeros = zeros.copy()
            for i in np.flatnonzero((zeros == 16) & ~escape[:active]).tolist():
                q, pos = 0, int(p[i])
                while not data[pos >> 3] << (pos & 7) & 0x80:
                    q, pos = q + 1, pos + 1
                zeros[i] = q
            rest = bits(p + zeros + 1, kk)
            value = (zeros << kk) | rest
            if any_escape:
                e = np.flatnonzero(escape[:active])
                signed = bits(p[e], kk[e])
                signed = np.where(kk[e] > 0, signed - ((signed >> np.maximum(kk[e] - 1, 0)) << kk[e]), 0)
                value[e] = (signed << 1) ^ (signed >> 63)
                zeros[e] = -1
        else:
            z = zeros.astype(U64)
            rest = ((view << (z + U64(1))) >> U64(1)) >> (63 - kk).astype(U64)
            value = (zeros << kk) | rest.astype(np.int64)
        zigzag[r, :active] = value
        at[:active] = p + zeros + 1 + kk
    residual = (zigzag >> 1) ^ -(zigzag & 1)
    return _predicted(residual, warm, weights, shift, order, size, linear)


#: The weights of the format's fixed predictors, by order.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _predicted(residual, warm, weights, shift, order, size, linear) -> list[np.ndarray]:
    """Undo the predictors: sums for fixed ones, sample by sample for linear ones."""
    n, longest = len(order), int(size.max())
    out = np.zeros((longest, n), np.int64)
    for o in range(int(order.max()) + 1):
        here = np.flatnonzero(order == o)
        out[:o, here] = warm[here, :o].T
        out[o:, here] = residual[: longest - o, here] if len(residual) >= longest - o else np.pad(residual, ((0, longest - o - len(residual)), (0, 0)))[:, here]
    for o in range(1, 5):
        here = np.flatnonzero(~linear & (order == o))
        if not len(here):
            continue
        if o <= 2:
            # Residuals are o-th differences, so o running sums from the warm-up restore the samples.
            block = out[:, here]
            if o == 2:
                first = np.concatenate([block[1:2] - block[:1], block[2:]])
                block[1:] = np.cumsum(first, axis=0)
            out[:, here] = np.cumsum(block, axis=0) if o == 1 else np.concatenate([block[:1], block[:1] + np.cumsum(block[1:], axis=0)])
        else:
            _linear(out, here, weights, shift, o)
    for o in np.unique(order[linear]).tolist():
        _linear(out, np.flatnonzero(linear & (order == o)), weights, shift, o)
    return [out[:s, i].astype(np.int8) for i, s in enumerate(size.tolist())]


def _linear(out, here, weights, shift, order) -> None:
    block = out[:, here]
    w = weights[here, :order][:, ::-1].T
    for t in range(order, len(block)):
        block[t] += (block[t - order : t] * w).sum(axis=0) >> shift[here]
    out[:, here] = block


def split_stream(media: bytes) -> tuple[list[bytes], list[int], bytes, int]:
    """Frames of a stream, the first sample of each, the MD5 and the number of samples.

    Where each frame is comes from the seek table, or else from a search for
    headers whose CRC-8 holds and that follow a frame whose CRC-16 holds.
    """
    if media[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, points, info = 4, False, [], b""
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    total = int.from_bytes(info[10:18], "big") & ((1 << 36) - 1)
    if sum(p[2] for p in points) == total and total:
        edges = [at + p[1] for p in points] + [len(media)]
        return [media[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], [p[0] for p in points], info[18:34], total
    frames, firsts, sample = [], [], 0
    while at < len(media):
        size = _parse_header(media[at : at + 16])[1]
        end = at + 1
        while True:
            end = media.find(b"\xff", end)
            end = len(media) if end < 0 else end
            if end == len(media) or media[end + 1 : end + 2] in (b"\xf8", b"\xf9"):
                if not crc16([media[at:end]]).any():
                    break
                if end == len(media):
                    raise FlacError("a frame fails its CRC-16")
            end += 1
        frames.append(media[at:end])
        firsts.append(sample)
        sample, at = sample + size, end
    return frames, firsts, info[18:34], total


def palette_of(media: bytes) -> np.ndarray | None:
    """The sample that each coded one (plus 128) stands for, if the stream bears a palette."""
    at, last = 4, False
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 2 and body[:4] == PALETTE:
            palette = np.frombuffer(body, np.uint8, offset=4)
            out = np.zeros(256, np.uint8)
            out[BY_RANK[: len(palette)]] = palette ^ 0x80
            return out.view(np.int8)
        at += 4 + size
    return None


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its PCM blocks: the first sample's number, and the samples, out of the palette if there is one."""
    parts = [split_stream(s) for s in streams]
    blocks = iter(decode_frames([f for frames, *_ in parts for f in frames]))
    out = []
    for stream, (frames, firsts, digest, total) in zip(streams, parts, strict=True):
        pcm = [next(blocks) for _ in frames]
        whole = b"".join(x.tobytes() for x in pcm)
        if len(whole) != total or hashlib.md5(whole).digest() != digest:
            raise FlacError("a stream fails its MD5")
        palette = palette_of(stream)
        if palette is not None:
            pcm = [palette[x.view(np.uint8) ^ 0x80] for x in pcm]
        out.append(list(zip(firsts, pcm, strict=True)))
    return out


def payload(text: bytes) -> bytes:
    """The bytes with zeros after them up to a positive multiple of 64."""
    return text + bytes(PAD - len(text) % PAD if len(text) % PAD or not text else 0)


def figures(pcm: np.ndarray) -> tuple[int, ...]:
    """Features of the samples: sum, energy, sign changes, least and largest."""
    x = pcm.astype(np.int64)
    return int(x.sum()), int((x * x).sum()), int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0))), int(x.min()), int(x.max())


MEDIA = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A FLAC stream for each text, in frames of ``block`` samples: doc_id, n_bytes and the column ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data, begin = bounds(piece.column("text"))
            raw = data.tobytes()
            coded = [ranked(payload(raw[a:b])) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            media = encode([c for c, _ in coded], palettes=[p for _, p in coded], block=block)
            yield pa.RecordBatch.from_arrays([piece.column("id").cast(pa.int64()), pa.array(np.diff(begin)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, MEDIA)


#: Figures of a whole text: digests are raw and features apart, as both pack better so.
WHOLE = pa.struct(
    [("n_bytes", pa.int64()), ("samples", pa.int64()), ("sha256", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary())]
    + [(name, pa.int64()) for name in ("sum", "energy", "crossings", "least", "largest")]
)
BLOCKS = (
    "doc_id long, row long, first_sample long, n_samples int, pcm binary, whole struct<n_bytes:long,samples:long,sha256:binary,"
    "media_bytes:long,media_sha256:binary,sum:long,energy:long,crossings:long,least:long,largest:long>"
)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks of a stored table like ``store``'s: one row for each frame, with its first sample's number.

    ``row`` tells the texts apart.  A text's last block bears figures of the
    whole: its length, the digests of its bytes and of its stream, and features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "media"):
            streams = piece.column("media").to_pylist()
            rows: list[tuple] = []
            for i, row, size, stream, blocks in zip(piece.column("doc_id").to_pylist(), piece.column("row").to_pylist(), piece.column("n_bytes").to_pylist(), streams, decode(streams), strict=True):
                pcm = np.concatenate([b for _, b in blocks])
                back = (pcm.view(np.uint8) ^ 0x80).tobytes()
                whole = (size, len(back), hashlib.sha256(back).digest(), len(stream), hashlib.sha256(stream).digest(), *figures(pcm))
                rows += [(i, row, first, len(b), b.tobytes(), None) for first, b in blocks[:-1]]
                rows.append((i, row, blocks[-1][0], len(blocks[-1][1]), blocks[-1][1].tobytes(), dict(zip((f.name for f in WHOLE), whole, strict=True))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), WHOLE)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "row", "first_sample", "n_samples", "pcm", "whole"])

    return media.select("doc_id", F.monotonically_increasing_id().alias("row"), "n_bytes", "media").mapInArrow(run, BLOCKS)


def samples_at(first: Column, count: Column) -> Column:
    """The samples [first, first + count) that a row of ``pcm_blocks`` holds, null if none."""
    begin = F.greatest(first, F.col("first_sample"))
    end = F.least(first + count, F.col("first_sample") + F.col("n_samples"))
    return F.when(begin < end, F.substring("pcm", (begin - F.col("first_sample") + 1).cast("int"), (end - begin).cast("int")))


def summaries(blocks: DataFrame) -> DataFrame:
    """Digests and features of each text of a stored table of ``pcm_blocks``.

    The tail is read by its offset: payload and block sizes are multiples of PAD,
    so it lies in one block, the only one of a text that is read here.
    """
    whole = F.col("whole")
    tail = samples_at(whole["samples"] - PAD, F.lit(PAD).cast("long"))
    # A CRC-32 is affine: that of the bytes follows from that of the samples, which are the bytes less 128.
    turned = zlib.crc32(b"\x80" * PAD) ^ zlib.crc32(bytes(PAD))
    feature = F.format_string("n=%d;sum=%d;energy=%d;crossings=%d;range=%d..%d", *[whole[c] for c in ("samples", "sum", "energy", "crossings", "least", "largest")])
    return blocks.filter(whole.isNotNull()).select(
        "doc_id",
        whole["n_bytes"].alias("n_bytes"),
        whole["samples"].alias("payload_bytes"),
        F.lower(F.hex(whole["sha256"])).alias("payload_sha256"),
        F.crc32(tail).bitwiseXOR(F.lit(turned)).alias("tail_crc32"),
        whole["media_bytes"].alias("media_bytes"),
        F.lower(F.hex(whole["media_sha256"])).alias("media_sha256"),
        feature.alias("feature"),
    )


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Texts as FLAC streams in a table of the shared folder, and their PCM blocks, decoded from it, in another, which is returned."""
    media = stored(store(docs, key, text, block), "flac", "zstd", TIGHT)
    blocks = stored(pcm_blocks(media), "pcm", "zstd", TIGHT)
    discard(media)
    return blocks
