"""Cache keys and lookups.

A key is a 128-bit digest of typed parts.  Spark's longs do not wrap around, and
a fold over bytes with JVM expressions took thirty times as long (26 s for
100,000 keys), so the digest is a function of Arrow batches: a numpy step mixes
the next byte of all rows, and no row is handled on its own.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Starts and multipliers of the digest's two lanes.
LOW_START, LOW_FACTOR = 0xCBF29CE484222325, 0x100000001B3
HIGH_START, HIGH_FACTOR = 0x84222325CBF29CE4, 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1


def encode_part(kind: str, value) -> bytes:
    """A part's bytes: its tag, then little-endian content, texts with their length before them."""
    if value is None:
        return b"n"
    if kind == "s":
        raw = str(value).encode()
        return b"s" + struct.pack("<Q", len(raw)) + raw
    if kind == "u":
        return b"u" + struct.pack("<Q", int(value) & WRAP)
    if kind == "i":
        return b"i" + struct.pack("<q", int(value))
    if kind == "b":
        return b"b" + bytes([bool(value)])
    if kind == "d":
        v = float(value)
        # One NaN, one zero: requests that nobody can tell apart share a key.
        return b"d" + (struct.pack("<Q", 0x7FF8000000000000) if math.isnan(v) else struct.pack("<d", v + 0.0))
    raise ValueError(f"no such kind of part: {kind}")


def digests(messages: Sequence[bytes]) -> list[tuple[int, int]]:
    """(high, low) of each message."""
    longest = max(map(len, messages), default=0)
    sizes = np.array([len(m) for m in messages])
    grid = np.zeros((longest, len(messages)), np.uint64)
    for k, m in enumerate(messages):
        grid[: len(m), k] = np.frombuffer(m, np.uint8)
    lanes = [np.full(len(messages), start, np.uint64) for start in (HIGH_START, LOW_START)]
    for at, byte in enumerate(grid):
        for lane, factor in zip(lanes, (HIGH_FACTOR, LOW_FACTOR), strict=True):
            mixed = (lane ^ byte) * np.uint64(factor)
            np.copyto(lane, mixed, where=at < sizes)
    return list(zip(lanes[0].tolist(), lanes[1].tolist(), strict=True))


def hex_digest(parts: Sequence[tuple[str, object]]) -> str:
    """The key of (kind, value) parts on the driver."""
    ((high, low),) = digests([b"".join(encode_part(k, v) for k, v in parts)])
    return f"{high:016x}{low:016x}"


def part_bytes(kind: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``encode_part`` for a batch: a row of bytes for each place, and how many each value has."""
    n = len(column)
    missing = np.asarray(column.is_null())
    tag = np.full((1, n), ord(kind), np.uint8)
    if kind == "s":
        text = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        at = np.arange(int(sizes.max(initial=0)))[:, None]
        body = np.zeros((len(at), n), np.uint8)
        inside = at < sizes
        body[inside] = raw[(offsets[:-1] + at)[inside]]
        parts, sizes = (tag, sizes.astype("<u8").view(np.uint8).reshape(n, 8).T, body), sizes + 9
    elif kind in ("u", "i", "d"):
        if kind == "d":
            value = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
            # One NaN, one zero: requests that nobody can tell apart share a key.
            bits = np.where(np.isnan(value), np.uint64(0x7FF8000000000000), value.view(np.uint64))
        else:
            bits = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        parts, sizes = (tag, np.ascontiguousarray(bits.astype("<u8")).view(np.uint8).reshape(n, 8).T), np.full(n, 9)
    elif kind == "b":
        parts, sizes = (tag, column.cast(pa.uint8()).fill_null(0).to_numpy(zero_copy_only=False)[None, :]), np.full(n, 2)
    else:
        raise ValueError(f"no such kind of part: {kind}")
    grid = np.concatenate(parts)
    grid[0, missing] = ord("n")
    return grid, np.where(missing, 1, sizes)


def lanes_of(kinds: str, columns: Sequence[pa.Array], wanted: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """The lanes (start, factor) over the parts of all rows of a batch."""
    n = len(columns[0])
    lanes = [np.full(n, start, np.uint64) for start, _ in wanted]
    for kind, column in zip(kinds, columns, strict=True):
        grid, sizes = part_bytes(kind, column)
        for at, byte in enumerate(grid.astype(np.uint64)):
            here = at < sizes
            for lane, (_, factor) in zip(lanes, wanted, strict=True):
                np.copyto(lane, (lane ^ byte) * np.uint64(factor), where=here)
    return lanes


def cache_key(kinds: str, *parts: Column) -> Column:
    """Hex digest column of parts whose kinds are letters: s text, u unsigned, i signed, b boolean, d double; null is null of any kind."""

    @F.arrow_udf("string")
    def key(*columns: pa.Array) -> pa.Array:
        high, low = lanes_of(kinds, columns, [(HIGH_START, HIGH_FACTOR), (LOW_START, LOW_FACTOR)])
        raw = np.stack([high, low], axis=1).astype(">u8").tobytes().hex()
        return pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.string())

    return key(*parts)


def read_key(band: Column, level: Column, step: Column, output_type: Column) -> Column:
    """What a read contributes: band, level or its absence, step and the type's name; budgets and statistics don't."""
    return cache_key("uuus", band, level, step, output_type)


def conversion_key(identity: str, arguments: dict[str, str], step: int, tile_size: int | None, policy: str, origin: tuple[float, float, float], versions: dict[str, str]) -> str:
    """The key of a conversion: whatever could change its result, arguments in their canonical spelling."""

    def canonical(text: str) -> str:
        try:
            return repr(float(text))
        except ValueError:
            return text

    named = [("s", x) for name in sorted(arguments) for x in (name, canonical(arguments[name]))]
    known = [("s", x) for name in sorted(versions) for x in (name, versions[name])]
    return hex_digest([("s", identity), *named, ("u", step), ("u", tile_size), ("s", policy), *[("d", v) for v in origin], *known])


def tile_hash(level: Column, x: Column, y: Column) -> Column:
    """The low lane over a tile's identity, as a signed long."""

    @F.arrow_udf("long")
    def low(*columns: pa.Array) -> pa.Array:
        (lane,) = lanes_of("uuu", columns, [(LOW_START, LOW_FACTOR)])
        return pa.array(lane.view(np.int64))

    return low(level, x, y)


#: States of a lookup.
STATES = ("Hit", "Miss", "StaleIdentity", "IdentityUnavailable", "Corrupt", "Disabled")


def lookup(requests: DataFrame, index: DataFrame, enabled: bool = True) -> DataFrame:
    """Requests (cache_key, identity) with the state of their entry in the index (cache_key, identity, valid)."""
    entry = index.select(F.col("cache_key").alias("_key"), F.col("identity").alias("_identity"), F.col("valid").alias("_valid"))
    state = (
        F.when(F.lit(not enabled), "Disabled")
        .when(F.col("identity").isNull(), "IdentityUnavailable")
        .when(F.col("_key").isNull(), "Miss")
        .when(~F.coalesce("_valid", F.lit(False)), "Corrupt")
        .when(~F.col("identity").eqNullSafe(F.col("_identity")), "StaleIdentity")
        .otherwise("Hit")
    )
    return requests.join(entry, F.col("cache_key") == F.col("_key"), "left").select(*requests.columns, state.alias("state"))
