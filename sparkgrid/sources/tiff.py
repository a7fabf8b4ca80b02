"""GeoTIFF containers: directories, metadata, segment layout, and planned reads."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from sparkgrid.diagnostics import Code, RasterError, Sink
from sparkgrid.functions.types import SAMPLE_TYPES
from sparkgrid.operators.grid import Window, choose_overview, factor_of, is_lossy
from sparkgrid.sources import codecs
from sparkgrid.sources.bytesource import ByteSource, exactly

#: The tags that are read; all others are passed over before their bytes are.
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip",
    279: "strip_counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets",
    325: "tile_counts", 339: "formats", 33550: "pixel_scale", 33922: "tiepoint", 34264: "matrix", 34735: "geo_keys",
    42112: "gdal_metadata", 42113: "gdal_nodata",
}
#: Field types as (size, struct letter).
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, None), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
ASCII, SHORT, DOUBLE = 2, 3, 12
#: Sample types by (format, bits).
TYPES = {(1, 8): "uint8", (1, 16): "uint16", (1, 32): "uint32", (2, 8): "int8", (2, 16): "int16", (2, 32): "int32", (3, 32): "float32", (3, 64): "float64"}
MOST_DIRECTORIES = 1024
MOST_METADATA_BYTES = 64 << 20
MOST_BATCH_BYTES = 64 << 10


@dataclass
class Field:
    kind: int
    count: int
    raw: bytes
    order: str

    def numbers(self) -> list:
        size, letter = FIELDS[self.kind]
        if letter in (None, "s"):
            raise RasterError(Code.InvalidOffset, "a numeric tag has a type that holds no number")
        return list(struct.unpack(f"{self.order}{self.count}{letter}", self.raw))

    def text(self) -> str:
        return self.raw.split(b"\0", 1)[0].decode("utf-8", "replace")


@dataclass
class Layout:
    """Where a directory's samples are."""

    order: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    tiled: bool
    planar: int
    compression: int
    predictor: int
    types: list[str]
    segments: list[tuple[int, int]]

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def per_plane(self) -> int:
        return self.across * -(-self.height // self.tile_height)

    def window(self, segment: int) -> Window:
        x, y = segment % self.across * self.tile_width, segment // self.across * self.tile_height
        return Window(x, y, min(self.tile_width, self.width - x), min(self.tile_height, self.height - y))

    def sizes(self) -> list[int]:
        return [SAMPLE_TYPES[t].size for t in self.types]

    def pixel_bytes(self, band: int) -> int:
        return self.sizes()[band - 1] if self.planar == 2 else sum(self.sizes())

    def stored_rows(self, segment: int) -> int:
        """Tiles are padded to their height; strips end with the raster."""
        return self.tile_height if self.tiled else self.window(segment).height

    def decoded_bytes(self, segment: int, band: int) -> int:
        return self.pixel_bytes(band) * self.tile_width * self.stored_rows(segment)


@dataclass
class Metadata:
    width: int
    height: int
    bands: list[dict]
    gt: tuple[float, ...] | None = None
    anchor: str | None = None
    crs: dict = field(default_factory=dict)
    native_tile: tuple[int, int] | None = None
    overviews: list[tuple[int, int]] = field(default_factory=list)

    def band(self, index: int) -> dict:
        for b in self.bands:
            if b["index"] == index:
                return b
        raise RasterError(Code.InvalidBandIndex, "the requested band does not exist", band=index)

    def bounds(self, window: Window | None = None) -> tuple[float, ...] | None:
        if self.gt is None or self.anchor is None:
            return None
        w = window or Window(0, 0, self.width, self.height)
        if w.empty:
            return None
        a0, a1, a2, b0, b1, b2 = self.gt
        less = self.anchor == "point"
        corners = [(float(px), float(py)) for py in (w.y, w.y + w.height - less) for px in (w.x, w.x + w.width - less)]
        xs, ys = [a0 + a1 * p + a2 * q for p, q in corners], [b0 + b1 * p + b2 * q for p, q in corners]
        return min(xs), min(ys), 0.0, max(xs), max(ys), 0.0


class Container:
    """A parsed file: metadata of the first directory, and every directory that has a size."""

    def __init__(self, source: ByteSource, sink: Sink | None = None):
        self.source, self.sink = source, sink or Sink()
        self.budget = MOST_METADATA_BYTES
        self.directories = self._directories()
        self.metadata, self.layout = self._decode(self.directories[0], self.sink)
        self.levels = []
        for d in self.directories[1:]:
            w, h = self._one(d, "width"), self._one(d, "height")
            if w and h:
                self.metadata.overviews.append((w, h))
                self.levels.append(d)

    def level(self, index: int) -> Layout:
        metadata, layout = self._decode(self.levels[index], Sink())
        if layout.types != self.layout.types:
            raise RasterError(Code.UnsupportedOverviewLevel, "an overview's sample types differ from the raster's")
        return layout

    def _directories(self) -> list[dict[str, Field]]:
        size = self.source.size()
        if size < 8:
            raise RasterError(Code.TruncatedHeader, "the header is truncated", byte_offset=0)
        head = exactly(self.source, 0, 8)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        if not self.order:
            raise RasterError(Code.InvalidSignature, "not a TIFF byte order mark", byte_offset=0)
        version, at = struct.unpack(f"{self.order}HI", head[2:])
        if version not in (42, 43):
            raise RasterError(Code.UnsupportedVersion, "unsupported TIFF version", byte_offset=2)
        self.big = version == 43
        if self.big:
            if size < 16:
                raise RasterError(Code.TruncatedHeader, "the BigTIFF header is truncated", byte_offset=0)
            width, zero, at = struct.unpack(f"{self.order}HHQ", exactly(self.source, 4, 12))
            if (width, zero) != (8, 0):
                raise RasterError(Code.UnsupportedVersion, "unsupported BigTIFF offset size", byte_offset=2)
        out = []
        while at:
            if len(out) == MOST_DIRECTORIES:
                raise RasterError(Code.InvalidOffset, "the chain of directories is too long", byte_offset=at)
            fields, at = self._directory(at)
            out.append(fields)
        if not out:
            raise RasterError(Code.InvalidOffset, "there are no image directories", byte_offset=0)
        return out

    def _directory(self, at: int) -> tuple[dict[str, Field], int]:
        counter, entry, tail = ("Q", 20, 8) if self.big else ("H", 12, 4)
        word = "Q" if self.big else "I"
        start = at + struct.calcsize(f"={counter}")
        (count,) = struct.unpack(f"{self.order}{counter}", exactly(self.source, at, start - at))
        room = self.source.size() - start
        if room < tail or count > (room - tail) // entry or count * entry + tail > MOST_METADATA_BYTES:
            raise RasterError(Code.InvalidOffset, "a directory exceeds the source", byte_offset=at)
        table = exactly(self.source, start, count * entry + tail)
        fields = {}
        for k in range(count):
            tag, kind, number = struct.unpack_from(f"{self.order}HH{word}", table, k * entry)
            if kind not in FIELDS:
                raise RasterError(Code.InvalidOffset, "a field has an invalid type", byte_offset=at)
            if tag not in TAGS:
                continue
            size = FIELDS[kind][0] * number
            self.budget -= size
            if self.budget < 0:
                raise RasterError(Code.InvalidOffset, "the metadata's values exceed the limit", byte_offset=at)
            slot = k * entry + (12 if self.big else 8)
            if size <= entry - (slot - k * entry):
                raw = table[slot : slot + size]
            else:
                raw = exactly(self.source, struct.unpack_from(f"{self.order}{word}", table, slot)[0], size)
            fields[TAGS[tag]] = Field(kind, number, raw, self.order)
        return fields, struct.unpack_from(f"{self.order}{word}", table, count * entry)[0]

    @staticmethod
    def _one(fields: dict[str, Field], name: str, default: int = 0) -> int:
        if name not in fields:
            return default
        numbers = fields[name].numbers()
        return int(numbers[0]) if numbers else 0

    def _decode(self, f: dict[str, Field], sink: Sink) -> tuple[Metadata, Layout]:
        one = lambda name, default=0: self._one(f, name, default)
        width, height, samples = one("width"), one("height"), one("samples", 1)
        if not width or not height or not samples:
            raise RasterError(Code.InvalidRasterSize, "dimensions or samples are missing or zero")
        bits = f["bits"].numbers() if "bits" in f else []
        formats = f["formats"].numbers() if "formats" in f else [1]
        if len(bits) not in {1, samples} or len(formats) not in {1, samples}:
            raise RasterError(Code.UnsupportedSampleFormat, "inconsistent sample metadata")
        pairs = [(formats[k if len(formats) > 1 else 0], bits[k if len(bits) > 1 else 0]) for k in range(samples)]
        types = [TYPES.get(p) for p in pairs]
        if None in types:
            raise RasterError(Code.UnsupportedSampleFormat, "unsupported sample format or bit depth")
        kinds = [SAMPLE_TYPES[t] for t in types]  # type: ignore[index]
        compression, predictor, planar = one("compression", 1), one("predictor", 1), one("planar", 1)
        if compression not in (codecs.NONE, codecs.LZW, codecs.DEFLATE, codecs.PACKBITS, codecs.OLD_DEFLATE):
            raise RasterError(Code.UnsupportedCompression, f"unsupported compression {compression}")
        if predictor not in (1, 2, 3) or ("predictor" in f and (f["predictor"].kind, f["predictor"].count) != (SHORT, 1)):
            raise RasterError(Code.UnsupportedSampleFormat, "unsupported predictor")
        if predictor == 3 and (not all(k.floating for k in kinds) or len({k.size for k in kinds}) > 1):
            raise RasterError(Code.UnsupportedSampleFormat, "the floating-point predictor needs floats of one width")
        if predictor == 2 and any(k.floating for k in kinds):
            raise RasterError(Code.UnsupportedSampleFormat, "the horizontal predictor needs integers")
        if planar not in (1, 2):
            raise RasterError(Code.UnsupportedPlanarConfiguration, "unsupported planar configuration")
        tiled = "tile_width" in f or "tile_height" in f
        if tiled:
            tile = one("tile_width"), one("tile_height")
        else:
            # A missing rows-per-strip means one strip.
            tile = width, min(one("rows_per_strip", height), height)
        if not all(tile):
            raise RasterError(Code.InconsistentTileLayout, "segment dimensions are invalid")
        offsets, counts = (f.get(f"{'tile' if tiled else 'strip'}_{n}") for n in ("offsets", "counts"))
        layout = Layout(self.order, width, height, *tile, tiled, planar, compression, predictor, types, [])  # type: ignore[arg-type]
        expected = layout.per_plane * (samples if planar == 2 else 1)
        if offsets is None or counts is None or not offsets.count == counts.count == expected:
            raise RasterError(Code.InconsistentTileLayout, "the segment list does not match the raster's layout")
        size = self.source.size()
        for offset, count in zip(offsets.numbers(), counts.numbers(), strict=True):
            if not count or offset > size or count > size - offset:
                raise RasterError(Code.InvalidOffset, "a segment extends beyond the source", byte_offset=offset)
            layout.segments.append((offset, count))
        bands = [{"index": k + 1, "data_type": t, "nodata": None, "scale": None, "offset": None, "description": "", "unit": ""} for k, t in enumerate(types)]
        m = Metadata(width, height, bands, native_tile=tile if tiled else None)
        self._georeference(f, m, sink)
        if "gdal_nodata" in f:
            value = nodata_value(f["gdal_nodata"])
            for b in bands:
                b["nodata"] = value
        if "gdal_metadata" in f and f["gdal_metadata"].kind == ASCII:
            describe_bands(f["gdal_metadata"].text(), bands)
        return m, layout

    def _georeference(self, f: dict[str, Field], m: Metadata, sink: Sink) -> None:
        keys: dict[int, int] = {}
        if "geo_keys" in f:
            g = f["geo_keys"]
            if g.kind != SHORT or g.count < 4 or (g.count - 4) % 4:
                raise RasterError(Code.InvalidCrs, "the key directory is invalid")
            numbers = g.numbers()
            for k in range(4, g.count, 4):
                key, location, _, value = numbers[k : k + 4]
                if location == 0:  # the value is here and not in another tag
                    keys.setdefault(key, value)
        kind = {1: "projected", 2: "geographic"}.get(keys.get(1024, 0), "unknown")
        epsg = keys.get(3072 if kind == "projected" else 2048) or None
        metre = kind == "projected" and keys.get(3076) == 9001
        m.crs = {
            "kind": kind, "epsg": epsg, "wkt": "", "citation": "", "linear_unit": "metre" if metre else "unknown", "linear_unit_metres": 0.0,
            "angular_unit": "unknown", "vertical_epsg": None, "vertical_unit": "unknown", "vertical_citation": "",
        }
        m.anchor = {1: "area", 2: "point"}.get(keys.get(1025, 0))
        matrix, scale, tie = f.get("matrix"), f.get("pixel_scale"), f.get("tiepoint")
        if matrix and (matrix.kind, matrix.count) != (DOUBLE, 16):
            raise RasterError(Code.InvalidGeoTransform, "a transformation matrix has sixteen doubles")
        if bool(scale) != bool(tie):
            raise RasterError(Code.InvalidGeoTransform, "pixel scale and tiepoint must appear together")
        if scale and ((scale.kind, scale.count) != (DOUBLE, 3) or tie.kind != DOUBLE or tie.count < 6):
            raise RasterError(Code.InvalidGeoTransform, "invalid pixel scale or tiepoint")
        from_scale = from_matrix = None
        if scale:
            (sx, sy, _), (px, py, _, x, y) = scale.numbers(), tie.numbers()[:5]
            from_scale = (x - sx * px, sx, 0.0, y - (-sy) * py, 0.0, -sy)
        if matrix:
            n = matrix.numbers()
            from_matrix = (n[3], n[0], n[1], n[7], n[4], n[5])
            if from_scale and from_matrix != from_scale:
                sink.warn(Code.ConflictingGeoTransform, "georeferencing tags disagree; using the matrix")
        m.gt = from_matrix or from_scale
        if m.gt:
            _, a1, a2, _, b1, b2 = m.gt
            det, size = a1 * b2 - a2 * b1, abs(a1) + abs(a2) + abs(b1) + abs(b2)
            if not math.isfinite(det) or det == 0 or abs(det) <= size * size * 1e-15:
                raise RasterError(Code.InvalidGeoTransform, "the transform has no inverse")
            if not m.anchor:
                sink.warn(Code.UnknownPixelAnchor, "pixel anchoring is absent")


NUMBER = re.compile(r"[ \t\n\v\f\r]*([+-]?(?:nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?))[ \t\n\v\f\r]*", re.IGNORECASE | re.ASCII)


def number_in(text: str) -> float | None:
    """The number that a text is, blanks around it aside; none if it is anything else or overflows."""
    m = NUMBER.fullmatch(text)
    value = float(m[1]) if m else math.inf
    if math.isinf(value) or (value == 0.0 and re.search("[1-9]", re.split("[eE]", m[1])[0])):  # type: ignore[index]
        return None
    return value


def nodata_value(tag: Field) -> float:
    value = number_in(tag.text()) if tag.kind == ASCII else None
    if value is None:
        raise RasterError(Code.InvalidNoDataValue, "the NoData tag is not a numeric text")
    return value


#: Entities, in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
ITEM = re.compile(r"<Item([^>]*)>(.*?)</Item>", re.DOTALL)


def unescape(text: str) -> str:
    for entity, character in ENTITIES:
        text = text.replace(entity, character)
    return text


def describe_bands(xml: str, bands: list[dict]) -> None:
    """Descriptions, units, scales and offsets of the items that name a sample (from 0)."""
    for attributes, body in ITEM.findall(xml):
        named = dict(re.findall(r'(\w+)="([^"]*)"', attributes))
        sample, name = named.get("sample", ""), named.get("name", "").lower()
        if not sample.isdigit() or int(sample) >= len(bands):
            continue
        band, text = bands[int(sample)], unescape(body)
        if name == "description":
            band["description"] = text
        elif name in ("unit", "unittype"):
            band["unit"] = text
        elif name in ("scale", "offset"):
            value = number_in(text)
            if value is not None and not math.isnan(value):
                band[name] = value


# Window reads ---------------------------------------------------------------------


@dataclass
class Options:
    band: int = 1
    step: int = 1
    level: int | None = None
    output_type: str = "float32"
    budget: int = 0
    nodata_stage: str = "converted"
    #: Polled before the first read and for each segment; a distributed read is
    #: cancelled with ``spark.addTag`` and ``spark.interruptTag``.
    cancelled: Callable[[], bool] | None = None


def check_cancelled(options: Options, window: Window) -> None:
    if options.cancelled and options.cancelled():
        raise RasterError(Code.Cancelled, "the window read was cancelled", window=(window.x, window.y, window.width, window.height), band=options.band)


@dataclass
class Plan:
    """What a window read will do: segments by batch of adjacent bytes, and its figures."""

    window: Window
    step: int
    factor: int
    layout: Layout
    band: int
    batches: list[list[int]]
    requested_bytes: int
    workspace: int

    def batch_range(self, batch: list[int]) -> tuple[int, int]:
        first, last = self.segment(batch[0]), self.segment(batch[-1])
        return first[0], last[0] + last[1] - first[0]

    def segment(self, k: int) -> tuple[int, int]:
        """Place of a segment; bands in planes of their own have segments of their own."""
        return self.layout.segments[k + (self.layout.per_plane * (self.band - 1) if self.layout.planar == 2 else 0)]

    @property
    def fetched_bytes(self) -> int:
        return sum(self.batch_range(b)[1] for b in self.batches)

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """For each sampled column and row the place in the level that is read."""
        across, down = self.window.sampled(self.step)
        return tuple((first + np.arange(n) * self.step) // self.factor for first, n in ((self.window.x, across), (self.window.y, down)))  # type: ignore[return-value]


def plan(container: Container, window: Window, options: Options) -> Plan:
    m = container.metadata
    band = m.band(options.band)
    step = max(1, options.step)
    level = choose_overview(m.width, [w for w, _ in m.overviews], step, options.level)
    factor = 1
    layout = container.layout
    if level is not None:
        factor = factor_of(m.width, m.overviews[level][0])
        if not factor:
            raise RasterError(Code.UnsupportedOverviewLevel, "the overview level has no valid scale", band=options.band)
        layout = container.level(level)
    place = {"window": (window.x, window.y, window.width, window.height), "band": options.band}
    if not window.inside(m.width, m.height):
        raise RasterError(Code.WindowOutOfBounds, "the requested window is outside the raster", **place)
    x0, y0 = window.x // factor, window.y // factor
    x1, y1 = -(-(window.x + window.width) // factor), -(-(window.y + window.height) // factor)
    met = []
    if not window.empty:
        rows = range(y0 // layout.tile_height, min(-(-layout.height // layout.tile_height), -(-y1 // layout.tile_height)))
        cols = range(x0 // layout.tile_width, min(layout.across, -(-x1 // layout.tile_width)))
        met = [r * layout.across + c for r in rows for c in cols]
    out = Plan(window, max(step, factor), factor, layout, options.band, [], window.width * window.height * SAMPLE_TYPES[band["data_type"]].size, 0)
    largest = 0
    for k in met:
        offset, count = out.segment(k)
        size = count
        if layout.compression != codecs.NONE:
            size += out.layout.decoded_bytes(k, options.band)
        elif layout.predictor == 3:
            size += layout.pixel_bytes(options.band) * layout.tile_width
        largest = max(largest, size)
        if out.batches:
            start, length = out.batch_range(out.batches[-1])
            if start + length == offset and length + count <= MOST_BATCH_BYTES:
                out.batches[-1].append(k)
                continue
        out.batches.append([k])
    if layout.compression == codecs.NONE:
        for b in out.batches:
            extra = max(out.segment(k)[1] for k in b) if layout.predictor != 1 else 0
            largest = max(largest, out.batch_range(b)[1] + extra)
    across, down = window.sampled(out.step)
    out.workspace = across * down * 8 + largest
    if options.budget and out.workspace > options.budget:
        raise RasterError(Code.MemoryBudgetExceeded, "this window needs more memory than its budget", **place)
    if is_lossy(band["data_type"], options.output_type):
        container.sink.warn(Code.LossyConversion, "the read applies a potentially lossy conversion", **place)
    return out


def decode_segment(layout: Layout, segment: int, band: int, raw: bytes) -> np.ndarray:
    """The band's samples (rows x columns, padding cut) of a segment's stored bytes."""
    planes = layout.planar == 2
    sizes = layout.sizes()
    rows, width = layout.stored_rows(segment), layout.tile_width
    samples = 1 if planes else len(sizes)
    data = np.frombuffer(codecs.decompress(raw, layout.compression, layout.decoded_bytes(segment, band)), np.uint8)
    size, kind = sizes[band - 1], SAMPLE_TYPES[layout.types[band - 1]]
    order = layout.order
    if layout.predictor == 3:
        data = codecs.undo_float_planes(data.reshape(rows, -1), samples, width, size).ravel()
        order = ">"
    elif layout.predictor == 2 and len(set(sizes)) == 1:
        numbers = data.view(f"{order}u{size}").astype(f"u{size}").reshape(rows, width, samples)
        data = codecs.undo_differences(numbers).astype(f"{order}u{size}").reshape(-1).view(np.uint8)
    elif layout.predictor == 2:
        raise RasterError(Code.UnsupportedSampleFormat, "the horizontal predictor needs samples of one width", band=band)
    at = 0 if planes else sum(sizes[: band - 1])
    letter = "f" if kind.floating else "i" if kind.signed else "u"
    pixels = data.reshape(rows, width, -1)[:, :, at : at + size]
    values = np.ascontiguousarray(pixels).view(f"{order}{letter}{size}")[:, :, 0].astype(np.float64)
    inside = layout.window(segment)
    return values[: inside.height, : inside.width]


def convert(values: np.ndarray, sample_type: str) -> np.ndarray:
    kind = SAMPLE_TYPES[sample_type]
    if kind.range:
        low, high = kind.range
        return np.where(np.isfinite(values), np.trunc(np.clip(np.nan_to_num(values), low, high)), 0.0) + 0.0
    with np.errstate(over="ignore"):
        return values.astype(np.float32).astype(np.float64) if kind.size == 4 else values


def finish(raw: np.ndarray, band: dict, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Scale and offset, the output type, and which samples are missing."""
    values = raw
    if band["scale"] is not None:
        values = values * band["scale"]
    if band["offset"] is not None:
        values = values + band["offset"]
    values = convert(values, options.output_type)
    nodata = band["nodata"]
    seen = raw if options.nodata_stage == "raw" else values
    if nodata is None:
        missing = np.zeros(values.shape, bool)
    else:
        missing = np.isnan(seen) if math.isnan(nodata) else seen == nodata
    return values, missing


def read_batch(source: ByteSource, p: Plan, batch: list[int], band: dict, options: Options):
    """For each segment of a batch, read at once: sampled columns, rows, values and missing samples."""
    start, length = p.batch_range(batch)
    data = exactly(source, start, length)
    columns, rows = p.columns()
    for k in batch:
        check_cancelled(options, p.window)
        offset, count = p.segment(k)
        values = decode_segment(p.layout, k, p.band, data[offset - start : offset - start + count])
        w = p.layout.window(k)
        c = np.flatnonzero((columns >= w.x) & (columns < w.x + w.width))
        r = np.flatnonzero((rows >= w.y) & (rows < w.y + w.height))
        if len(c) and len(r):
            yield c, r, *finish(values[np.ix_(rows[r] - w.y, columns[c] - w.x)], band, options)


def read_window(source: ByteSource, window: Window, options: Options | None = None, sink: Sink | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """A window's samples in one piece (rows x columns), which are missing, and the read's statistics."""
    options = options or Options()
    container = Container(source, sink)
    p = plan(container, window, options)
    check_cancelled(options, window)
    across, down = window.sampled(p.step)
    values, missing = np.full((down, across), np.nan), np.zeros((down, across), bool)
    for batch in p.batches:
        for c, r, v, gone in read_batch(source, p, batch, container.metadata.band(options.band), options):
            values[np.ix_(r, c)], missing[np.ix_(r, c)] = v, gone
    requested, fetched = p.requested_bytes, p.fetched_bytes
    return values, missing, {"requested_bytes": requested, "fetched_bytes": fetched, "request_count": len(p.batches), "amplification": fetched / requested if requested else 0.0}


def tile_window(container: Container, seg_x: int, seg_y: int, level: int | None = None) -> Window:
    """The full-resolution window of a native segment, of a level's mapped back and clipped."""
    m = container.metadata
    layout = container.layout if level is None else container.level(level)
    factor = 1 if level is None else factor_of(m.width, m.overviews[level][0])
    if seg_x >= layout.across or seg_y >= -(-layout.height // layout.tile_height):
        raise RasterError(Code.WindowOutOfBounds, "the requested tile is outside the raster")
    w = layout.window(seg_y * layout.across + seg_x)
    x, y = w.x * factor, w.y * factor
    return Window(x, y, max(0, min(w.width * factor, m.width - x)), max(0, min(w.height * factor, m.height - y)))
