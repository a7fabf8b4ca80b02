"""The "geogrid" data source: TIFF files as relations.

``relation`` is one of rasters, segments, chunks, pixels, read_stats, diagnostics.
The driver lists files and their sizes and opens none; a task takes a share of a
file, or several small files, parses the header, plans which bytes the query
needs, and reads and decodes its share of them.  For pixels and chunks, filters on
i, j and band are taken as a window and a band, so segments outside them are never
read; Spark checks all filters again.  A window, a step or a level can also be given
as options.  Paths are local or URIs of stores that pyarrow reads by range.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from sparkgrid.args import can_read, safe_label
from sparkgrid.diagnostics import ROW, Code, RasterError, Sink
from sparkgrid.functions.bounds import FIELDS
from sparkgrid.functions.affine import TERMS
from sparkgrid.operators.grid import Window
from sparkgrid.sources import tiff
from sparkgrid.sources.bytesource import ByteSource, has_scheme, open_source

BAND = "struct<index:int,data_type:string,nodata:double,scale:double,offset:double,description:string,unit:string>"
CRS = (
    "struct<kind:string,epsg:int,wkt:string,citation:string,linear_unit:string,linear_unit_metres:double,angular_unit:string,"
    "vertical_epsg:int,vertical_unit:string,vertical_citation:string>"
)
SIZE = "struct<width:bigint,height:bigint>"
SCHEMAS = {
    "rasters": f"raster_id string, source_label string, width bigint, height bigint, band_count int, bands array<{BAND}>, gt struct<{','.join(f'{t}:double' for t in TERMS)}>, "
    f"has_gt boolean, pixel_anchor string, pixel_anchor_source string, crs {CRS}, native_tile {SIZE}, overviews array<{SIZE}>, bounds struct<{','.join(f'{t}:double' for t in FIELDS)}>",
    "segments": "raster_id string, level int, band int, seg_x bigint, seg_y bigint, x0 bigint, y0 bigint, w bigint, h bigint, byte_offset bigint, byte_count bigint",
    "chunks": "raster_id string, band int, level int, x0 bigint, y0 bigint, w bigint, h bigint, samples array<double>",
    "pixels": "raster_id string, band int, step bigint, c bigint, r bigint, i bigint, j bigint, value double, is_nodata boolean",
    "read_stats": "raster_id string, requested_bytes bigint, fetched_bytes bigint, request_count bigint, amplification double",
    "diagnostics": ROW,
}
#: Bytes of files, or of a file's share, that one task takes, and pixels of an Arrow batch.
TASK_BYTES = 8 << 20
ARROW_ROWS = 1 << 16
#: Files whose headers alone one task reads.
FILES_OF_A_TASK = 64


def sized_files(paths: list[str]) -> list[tuple[str, int]]:
    """TIFF files, and their sizes, of files, folders and patterns, in order of names."""
    out: list[tuple[str, int]] = []
    for path in paths:
        if has_scheme(path):
            store, inner = pafs.FileSystem.from_uri(path)
            head = path[: len(path) - len(inner.lstrip("/"))] if path.endswith(inner.lstrip("/")) else path.partition("//")[0] + "//"
            info = store.get_file_info(inner)
            found = [info] if info.is_file else sorted(store.get_file_info(pafs.FileSelector(inner, recursive=True)), key=lambda f: f.path)
            out += [(head + f.path.lstrip("/"), f.size) for f in found if f.is_file and (f is info or can_read(f.path))]
            continue
        path = re.sub(r"^file:(//)?", "", path)
        folder, pattern = os.path.isdir(path), any(c in path for c in "*?[")
        names = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if folder else sorted(glob.glob(path)) or [path]
        if folder or pattern:
            names = [f for f in names if can_read(f) and not os.path.isdir(f)]
        out += [(f, os.path.getsize(f) if os.path.exists(f) else 0) for f in names]
    return out


def files_of(paths: list[str]) -> list[str]:
    return [f for f, _ in sized_files(paths)]


def numbers(text: str | None, count: int, name: str) -> list[int] | None:
    if text is None:
        return None
    try:
        out = [int(x) for x in text.split(",")]
    except ValueError:
        out = []
    if len(out) != count or min(out) < 0:
        raise RasterError(Code.InvalidFormatArgument, f"{name} takes {count} whole numbers")
    return out


@dataclass
class Part(InputPartition):
    """Work of a task: shares (path, which, of how many) of files, and what filters allow."""

    shares: list[tuple[str, int, int]]
    band: int | None = None
    low: dict | None = None
    high: dict | None = None


class GeoGridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geogrid"

    def schema(self) -> str:
        relation = self.options.get("relation", "rasters")
        if relation not in SCHEMAS:
            raise RasterError(Code.InvalidFormatArgument, f"relation must be one of {', '.join(SCHEMAS)}")
        return SCHEMAS[relation]

    def reader(self, schema):
        """Readers that take filters, unless ``pushdown`` is "false".

        Spark refuses them where spark.sql.python.filterPushdown.enabled is off;
        ``register`` turns it on.  Readers are made in processes without a
        session, so the setting cannot be asked here.
        """
        return (Reader if self.options.get("pushdown", "true").lower() == "false" else PushingReader)(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.relation = options.get("relation", "rasters")
        self.low, self.high = {"i": 0, "j": 0}, {"i": None, "j": None}
        self.band: int | None = None

    # Names of options are kept in lower case by Spark.
    def option(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.options.items() if k.lower() == name.lower()), default)

    def read_options(self) -> tiff.Options:
        level = self.option("overviewLevel")
        band = self.band or int(self.option("band", "1"))
        return tiff.Options(band, int(self.option("step", "1")), None if level is None else int(level), self.option("outputType", "float32"), int(self.option("memoryBudget", "0")), self.option("nodataStage", "converted"))

    def files(self) -> list[tuple[str, int]]:
        paths = self.option("paths")
        return sized_files(paths.split(";") if paths else [self.option("path") or ""])

    def window(self, container: tiff.Container) -> Window:
        """The requested window, cut to what filters allow."""
        m = container.metadata
        box = numbers(self.option("window"), 4, "window")
        tile = numbers(self.option("tile"), 2, "tile")
        lines = numbers(self.option("scanlines"), 2, "scanlines")
        if tile:
            level = self.option("overviewLevel")
            w = tiff.tile_window(container, *tile, level=None if level is None else int(level))
        elif lines:
            w = Window(0, lines[0], m.width, lines[1])
        else:
            w = Window(*box) if box else Window(0, 0, m.width, m.height)
        if not w.inside(m.width, m.height):
            raise RasterError(Code.WindowOutOfBounds, "the requested window is outside the raster", window=(w.x, w.y, w.width, w.height))
        if self.option("step", "1") not in ("0", "1"):
            return w  # a step counts from the window's origin, which a filter must not move
        x, y = max(w.x, self.low["i"]), max(w.y, self.low["j"])
        x1 = min(w.x + w.width, w.x + w.width if self.high["i"] is None else self.high["i"] + 1)
        y1 = min(w.y + w.height, w.y + w.height if self.high["j"] is None else self.high["j"] + 1)
        return Window(x, y, max(0, x1 - x), max(0, y1 - y)) if x1 > x and y1 > y else Window(w.x, w.y, 0, 0)

    def partitions(self) -> list[Part]:
        """Shares of large files and groups of small ones, from the listing alone."""
        whole = self.relation in ("rasters", "segments", "read_stats", "diagnostics")
        out, group, size = [], [], 0
        for path, length in self.files():
            count = 1 if whole else max(1, -(-length // TASK_BYTES))
            if count > 1:
                out += [[(path, k, count)] for k in range(count)]
                continue
            group.append((path, 0, 1))
            size += min(length, TASK_BYTES) if not whole else TASK_BYTES // FILES_OF_A_TASK
            if size >= TASK_BYTES:
                out.append(group)
                group, size = [], 0
        # Filters are pushed where reads are planned; a task knows of them by its part.
        return [Part(shares, self.band, self.low, self.high) for shares in ([*out, group] if group else out)]

    def read(self, part: Part) -> Iterator:
        self.band, self.low, self.high = part.band, part.low or self.low, part.high or self.high
        for path, which, count in part.shares:
            if self.relation == "diagnostics":
                yield from self.read_diagnostics(path)
                continue
            with closing(open_source(path)) as source:
                container = tiff.Container(source, Sink())
                if self.relation == "rasters":
                    yield raster_row(path, container.metadata)
                elif self.relation == "segments":
                    yield from segment_rows(path, container)
                elif self.relation == "read_stats":
                    p = tiff.plan(container, self.window(container), self.read_options())
                    fetched, asked = p.fetched_bytes, p.requested_bytes
                    yield path, asked, fetched, len(p.batches), fetched / asked if asked else 0.0
                elif self.relation == "chunks":
                    yield from self.read_chunks(path, which, count, source, container)
                else:
                    yield from self.read_pixels(path, which, count, source, container)

    def share(self, p: tiff.Plan, which: int, count: int) -> list[list[int]]:
        """The batches of a plan that fall to one of so many tasks, about equal in bytes."""
        if count == 1:
            return p.batches
        sizes = np.cumsum([p.batch_range(b)[1] for b in p.batches])
        at = (sizes - 1) * count // max(1, sizes[-1]) if len(sizes) else sizes
        return [b for b, k in zip(p.batches, at, strict=True) if k == which]

    def read_diagnostics(self, path: str) -> Iterator[tuple]:
        sink = Sink()
        try:
            with closing(open_source(path)) as source:
                container = tiff.Container(source, sink)
                if self.option("window"):
                    tiff.plan(container, self.window(container), self.read_options())
        except RasterError as error:
            sink.found.append(error.diagnostic)
        for seq, d in enumerate(sink.found):
            yield d.row(path, seq)

    def read_chunks(self, path: str, which: int, count: int, source: ByteSource, container: tiff.Container) -> Iterator[tuple]:
        """Whole segments, in the order of their rows, as the file stores them at the level read."""
        options = self.read_options()
        p = tiff.plan(container, self.window(container), options)
        band = container.metadata.band(options.band)
        level = -1 if p.layout is container.layout else (options.level if options.level is not None else -1)
        for batch in self.share(p, which, count):
            start, length = p.batch_range(batch)
            data = tiff.exactly(source, start, length)
            for k in batch:
                offset, size = p.segment(k)
                values, _ = tiff.finish(tiff.decode_segment(p.layout, k, p.band, data[offset - start : offset - start + size]), band, options)
                w = p.layout.window(k)
                yield path, p.band, level, w.x, w.y, w.width, w.height, values.ravel().tolist()

    def read_pixels(self, path: str, which: int, count: int, source: ByteSource, container: tiff.Container) -> Iterator[pa.RecordBatch]:
        options = self.read_options()
        p = tiff.plan(container, self.window(container), options)
        band = container.metadata.band(options.band)
        for batch in self.share(p, which, count):
            for c, r, values, missing in tiff.read_batch(source, p, batch, band, options):
                yield from pixel_batches(path, p, np.tile(c, len(r)), np.repeat(r, len(c)), values.ravel(), missing.ravel())
        yield from self.uncovered(path, p, which, count)

    def uncovered(self, path: str, p: tiff.Plan, which: int, count: int) -> Iterator[pa.RecordBatch]:
        """Samples past the level that is read, line by line of this task's share of the lines."""
        columns, rows = p.columns()
        if p.window.empty or (columns[-1] < p.layout.width and rows[-1] < p.layout.height):
            return
        beyond = np.flatnonzero(columns >= p.layout.width)
        whole = np.arange(len(columns))
        for r in range(len(rows) * which // count, len(rows) * (which + 1) // count):
            c = whole if rows[r] >= p.layout.height else beyond
            if len(c):
                yield from pixel_batches(path, p, c, np.full(len(c), r), None, None)


class PushingReader(Reader):
    def pushFilters(self, filters):  # noqa: N802
        """Take bounds on i, j and band; hand all filters back for Spark to check."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.low and self.relation == "pixels" and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    top = f.value - isinstance(f, LessThan)
                    self.high[name] = top if self.high[name] is None else min(self.high[name], top)
            elif name == "band" and self.relation in ("pixels", "chunks") and isinstance(f, EqualTo) and self.option("band") is None:
                self.band = f.value
            yield f


def pixel_batches(path: str, p: tiff.Plan, c: np.ndarray, r: np.ndarray, values: np.ndarray | None, missing: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(c), ARROW_ROWS):
        cc, rr = c[at : at + ARROW_ROWS], r[at : at + ARROW_ROWS]
        n = len(cc)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([path]).take(pa.array(np.zeros(n, np.int8))), pa.array(np.full(n, p.band, np.int32)), pa.array(np.full(n, p.step)), pa.array(cc.astype(np.int64)), pa.array(rr.astype(np.int64)),
                pa.array(p.window.x + cc * p.step), pa.array(p.window.y + rr * p.step),
                pa.nulls(n, pa.float64()) if values is None else pa.array(values[at : at + n]),
                pa.array(np.zeros(n, bool)) if missing is None else pa.array(missing[at : at + n]),
            ],
            ["raster_id", "band", "step", "c", "r", "i", "j", "value", "is_nodata"],
        )


def raster_row(path: str, m: tiff.Metadata) -> tuple:
    bands = [tuple(b[n] for n in ("index", "data_type", "nodata", "scale", "offset", "description", "unit")) for b in m.bands]
    anchor_source = "file" if m.anchor else None
    return (path, safe_label(path), m.width, m.height, len(bands), bands, m.gt, m.gt is not None, m.anchor, anchor_source, tuple(m.crs.values()), m.native_tile, m.overviews, m.bounds())


def segment_rows(path: str, container: tiff.Container) -> Iterator[tuple]:
    for level in range(-1, len(container.levels)):
        layout = container.layout if level < 0 else container.level(level)
        for k, (offset, count) in enumerate(layout.segments):
            plane, s = divmod(k, layout.per_plane)
            w = layout.window(s)
            yield path, level, plane + 1 if layout.planar == 2 else None, s % layout.across, s // layout.across, w.x, w.y, w.width, w.height, offset, count


def rasters_from_bytes(files):
    """``rasters`` rows of a ``binaryFile`` DataFrame: for stores that only Spark reads."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMAS["rasters"])
    arrow = to_arrow_schema(schema)
    plain = lambda v, t: {f.name: plain(x, f.dataType) for f, x in zip(t.fields, v, strict=True)} if isinstance(t, StructType) and v is not None else [plain(x, t.elementType) for x in v] if hasattr(t, "elementType") and v is not None else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkgrid.sources.bytesource import MemorySource

        for batch in batches:
            for k in range(batch.num_rows):
                path, data = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                row = raster_row(path, tiff.Container(MemorySource(data)).metadata)
                yield pa.RecordBatch.from_pylist([plain(row, schema)], arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def pixels_from_bytes(files, options: tiff.Options | None = None, window: Window | None = None):
    """``pixels`` rows of a ``binaryFile`` DataFrame; a file is a row, so this is for files that fit a task."""
    options = options or tiff.Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkgrid.sources.bytesource import MemorySource

        for batch in batches:
            for k in range(batch.num_rows):
                path, data = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                source = MemorySource(data)
                container = tiff.Container(source)
                m = container.metadata
                p = tiff.plan(container, window or Window(0, 0, m.width, m.height), options)
                for group in p.batches:
                    for c, r, values, missing in tiff.read_batch(source, p, group, m.band(options.band), options):
                        yield from pixel_batches(path, p, np.tile(c, len(r)), np.repeat(r, len(c)), values.ravel(), missing.ravel())

    return files.select("path", "content").mapInArrow(run, SCHEMAS["pixels"])
