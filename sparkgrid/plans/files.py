"""Queries over raster files: GeoTIFFs made of the events, written to the shared folder and read by ``geogrid``.

A raster is a block of 100 lines of the dem; each comes in every variant of
layout, codec, predictor, byte order and sample type, as a file of its own.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid import args
from sparkgrid.diagnostics import RasterError
from sparkgrid.functions.windows import div
from sparkgrid.plans import rasters
from sparkgrid.plans.rasters import WIDTH
from sparkgrid.scratch import shared_dir
from sparkgrid.sources import register, sink
from sparkgrid.sources.datasource import pixels_from_bytes, rasters_from_bytes
from sparkgrid.sources.tiffwriter import tiff

LINES = 100
#: For each variant the sample type, the band of VALUES that it holds, and how it is written.
VARIANTS = {
    "strips": ("f8", "elevation", {"rows": 8, "nodata": "-9999", "scale": 2.0}),
    "bigtiff": ("f8", "elevation", {"rows": 16, "big": True, "nodata": "-9999"}),
    "bigendian": ("f4", "half", {"rows": 8, "order": ">"}),
    "tiles": ("u2", "code", {"tile": (32, 16)}),
    "deflate": ("u2", "code", {"tile": (32, 32), "compression": 8, "predictor": 2}),
    "lzw": ("i2", "signed", {"rows": 10, "compression": 5, "anchor": 2}),
    "packbits": ("u1", "byte", {"rows": 25, "compression": 32773}),
    "floating": ("f4", "half", {"tile": (64, 64), "compression": 8, "predictor": 3, "order": ">"}),
    "planar": ("i4", "two", {"rows": 20, "planar": 2}),
    "pixels": ("i4", "two", {"tile": (16, 16), "compression": 8}),
    "scaled": ("u2", "code", {"rows": 8, "gdal": '<GDALMetadata><Item name="SCALE" sample="0">0.5</Item><Item name="OFFSET" sample="0">100</Item><Item name="Description" sample="0">a &amp; b</Item></GDALMetadata>'}),
    "overview": ("u2", "code", {"rows": 8, "geo": False}),
}
#: The bands' samples in terms of the events, in both languages.
VALUES = {
    "elevation": "CASE WHEN event_type = 'error' THEN -9999.0 ELSE value END",
    "half": "(event_id % 1000) * 0.5 - 100",
    "code": "event_id * 7 % 65536",
    "signed": "event_id % 32768 - 16384",
    "byte": "event_id % 251",
    "two": "event_id",
}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster, place and bands of every event."""
    e, line = F.col("event_id"), div(F.col("event_id"), F.lit(WIDTH))
    bands = [F.expr(f"cast({sql} as double)").alias(n) for n, sql in VALUES.items()]
    return rasters.events(spark, sf_dir).select(div(line, F.lit(LINES)).cast("string").alias("raster"), (line % LINES).alias("j"), (e % WIDTH).alias("i"), *bands)


def encoded(raster: str, grid: np.ndarray):
    """The files of a raster: every variant's name and bytes."""
    names = list(VALUES)
    for name, (kind, band, how) in VARIANTS.items():
        data = grid[:, :, names.index(band)].astype(kind)
        if band == "two":
            data = np.stack([data, -data], axis=2)
        more = {"overviews": [data[::2, ::2]]} if name == "overview" else {}
        yield f"{name}-{raster}.tif", tiff(data, **how, **more)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.images(samples(spark, sf_dir), WIDTH, encoded)


def folder(spark: SparkSession, table: DataFrame) -> str:
    """A new shared folder with the images of a table."""
    path = f"{shared_dir(spark)}/rasters-{uuid.uuid4().hex}"
    sink.write_files(table, path)
    return path


def read(spark: SparkSession, path: str, relation: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("geogrid").options(relation=relation, **options).load(path)


def label() -> list[Column]:
    """Variant and number of the raster that a row's file holds."""
    name = F.regexp_extract("raster_id", r"([a-z]+)-(\d+)\.tif$", 1)
    return [name.alias("variant"), F.regexp_extract("raster_id", r"([a-z]+)-(\d+)\.tif$", 2).cast("long").alias("raster")]


QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def case(by: dict[str, str], otherwise: str = "") -> str:
    """A CASE over the variants, one arm for each value."""
    arms = {}
    for name, value in by.items():
        arms.setdefault(value, []).append(f"'{name}'")
    return "CASE " + " ".join(f"WHEN variant IN ({', '.join(n)}) THEN {v}" for v, n in arms.items()) + f"{otherwise} END"


NAMES = ", ".join(f"('{n}')" for n in VARIANTS)
SAMPLE_SQL = case({n: f"({VALUES[band]})::DOUBLE{' * 0.5::DOUBLE + 100.0::DOUBLE' if n == 'scaled' else ''}" for n, (_, band, _) in VARIANTS.items()})
#: All pixels of every variant's first band, and the rasters with their lines.
FILES = f"""v AS (SELECT * FROM (VALUES {NAMES}) t(variant)),
    p AS (SELECT variant, event_id // {WIDTH * LINES} AS raster, event_id % {WIDTH} AS i, event_id // {WIDTH} % {LINES} AS j, {SAMPLE_SQL} AS value,
        variant IN ('strips', 'bigtiff') AND event_type = 'error' AS is_nodata FROM events, v),
    r AS (SELECT variant, raster, max(j) + 1 AS height FROM p GROUP BY 1, 2)"""


@query(f"WITH {FILES} SELECT variant, raster, i, j, value, is_nodata FROM p")
def tiff_roundtrip(spark, sf_dir):
    """Every sample of every variant, decoded from its file in full precision."""
    pixels = read(spark, folder(spark, images(spark, sf_dir)), "pixels", outputType="float64")
    return pixels.select(*label(), "i", "j", "value", "is_nodata")


@query(f"WITH {FILES} SELECT variant, raster, i, j, value::FLOAT::DOUBLE AS value FROM p WHERE i >= 20 AND i < 57 AND j >= 5 AND j < 24")
def tiff_window(spark, sf_dir):
    """A window given as filters, which choose the segments that are read."""
    pixels = read(spark, folder(spark, images(spark, sf_dir)), "pixels")
    return pixels.filter("i >= 20 AND i < 57 AND j >= 5 AND j < 24").select(*label(), "i", "j", "value")


@query(f"WITH {FILES} SELECT variant, raster, i, j, (i - 3) // 4 AS c, (j - 2) // 4 AS r, trunc(least(greatest(value, 0), 255)) + 0.0::DOUBLE AS value FROM p WHERE variant <> 'overview' AND i >= 3 AND i < 53 AND j >= 2 AND j < 10 AND (i - 3) % 4 = 0 AND (j - 2) % 4 = 0")
def tiff_decimate(spark, sf_dir):
    """A window with a step, its samples converted to bytes."""
    table = images(spark, sf_dir).filter("name NOT LIKE 'overview%'")
    pixels = read(spark, folder(spark, table), "pixels", window="3,2,50,8", step="4", outputType="uint8")
    return pixels.select(*label(), "i", "j", "c", "r", "value")


@query(f"WITH {FILES} SELECT raster, c, r, a.i, a.j, b.value FROM (SELECT raster, i // 3 AS c, j // 3 AS r, i, j FROM p WHERE variant = 'overview' AND i % 3 = 0 AND j % 3 = 0) a JOIN (SELECT raster, i, j, value FROM p WHERE variant = 'overview') b USING (raster) WHERE b.i = a.i // 2 * 2 AND b.j = a.j // 2 * 2")
def tiff_overview(spark, sf_dir):
    """A step of 3 that the overview by 2 serves."""
    path = folder(spark, images(spark, sf_dir).filter("name LIKE 'overview%'"))
    return read(spark, path, "pixels", step="3", outputType="float64").select(label()[1], "c", "r", "i", "j", "value")


@query(f"WITH {FILES} SELECT variant, raster, i, j, -value AS value FROM p WHERE variant IN ('planar', 'pixels')")
def tiff_band(spark, sf_dir):
    """The second band, chosen by a filter: in planes of its own and beside the first."""
    path = folder(spark, images(spark, sf_dir).filter("name LIKE 'planar%' OR name LIKE 'pixels%'"))
    return read(spark, path, "pixels", outputType="float64").filter("band = 2").select(*label(), "i", "j", F.col("value"))


def _of(key: str, otherwise: str) -> str:
    return case({n: str(how[key]) for n, (_, _, how) in VARIANTS.items() if key in how}, f" ELSE {otherwise}")


TYPE_NAMES = {"f8": "float64", "f4": "float32", "u1": "uint8", "u2": "uint16", "i2": "int16", "i4": "int32"}
TYPES_SQL = case({n: f"'{TYPE_NAMES[kind]}'" for n, (kind, _, _) in VARIANTS.items()})


@query(f"""WITH {FILES} SELECT variant, raster, {WIDTH}::BIGINT AS width, height, CASE WHEN variant IN ('planar', 'pixels') THEN 2 ELSE 1 END::INT AS band_count, {TYPES_SQL} AS data_type,
        CASE WHEN variant IN ('strips', 'bigtiff') THEN -9999.0 END::DOUBLE AS nodata, CASE WHEN variant = 'scaled' THEN 0.5 END::DOUBLE AS scale, CASE WHEN variant = 'scaled' THEN 100.0 END::DOUBLE AS "offset",
        CASE WHEN variant = 'scaled' THEN 'a & b' ELSE '' END AS description, CASE WHEN variant = 'overview' THEN NULL WHEN variant = 'lzw' THEN 'point' ELSE 'area' END AS anchor,
        CASE WHEN variant <> 'overview' THEN 32654 END::INT AS epsg, CASE WHEN variant = 'overview' THEN 'unknown' ELSE 'metre' END AS unit, CASE WHEN variant <> 'overview' THEN 300000.0 END::DOUBLE AS a0, CASE WHEN variant <> 'overview' THEN -2.0 END::DOUBLE AS b2,
        CASE WHEN variant = 'overview' THEN NULL WHEN variant = 'lzw' THEN 300000.0 + 2.0 * {WIDTH - 1} ELSE 300000.0 + 2.0 * {WIDTH} END::DOUBLE AS max_x,
        CASE WHEN variant = 'overview' THEN NULL WHEN variant = 'lzw' THEN 4400000.0 - 2.0 * (height - 1) ELSE 4400000.0 - 2.0 * height END::DOUBLE AS min_y,
        CASE WHEN variant IN ('tiles', 'deflate') THEN 32 WHEN variant = 'floating' THEN 64 WHEN variant = 'pixels' THEN 16 END::BIGINT AS tile_width,
        CASE WHEN variant = 'overview' THEN 1 ELSE 0 END::INT AS overviews FROM r""")
def tiff_rasters(spark, sf_dir):
    """Metadata of every file: size, bands, georeferencing, layout and overviews."""
    return _described(read(spark, folder(spark, images(spark, sf_dir)), "rasters"))


def _described(found: DataFrame) -> DataFrame:
    band = F.col("bands")[0]
    return found.select(
        *label(), "width", "height", "band_count", band["data_type"].alias("data_type"), band["nodata"].alias("nodata"), band["scale"].alias("scale"), band["offset"].alias("offset"), band["description"].alias("description"),
        F.col("pixel_anchor").alias("anchor"), F.col("crs.epsg").alias("epsg"), F.col("crs.linear_unit").alias("unit"), F.col("gt.a0").alias("a0"), F.col("gt.b2").alias("b2"), F.col("bounds.max_x").alias("max_x"),
        F.col("bounds.min_y").alias("min_y"), F.col("native_tile.width").alias("tile_width"), F.size("overviews").alias("overviews"),
    )


@query(ORACLE_SQL["tiff_rasters"])
def tiff_rasters_in_rows(spark, sf_dir):
    """The same of images that are rows of a table, as a store that only Spark reads gives them."""
    return _described(rasters_from_bytes(images(spark, sf_dir).select(F.col("name").alias("path"), F.col("image").alias("content"))))


@query(f"WITH {FILES} SELECT variant, raster, i, j, value::FLOAT::DOUBLE AS value FROM p")
def tiff_pixels_in_rows(spark, sf_dir):
    """Samples of images that are rows of a table."""
    return pixels_from_bytes(images(spark, sf_dir).select(F.col("name").alias("path"), F.col("image").alias("content"))).select(*label(), "i", "j", "value")


#: Height and width of the segments of the uncompressed variants, and bytes of a pixel in them.
PLAIN = {n: (how.get("tile", (WIDTH, how.get("rows")))[0], how.get("tile", (WIDTH, how.get("rows")))[1], int(kind[1]), "tile" in how) for n, (kind, _, how) in VARIANTS.items() if "compression" not in how and n != "overview"}
PLAIN_SQL = ", ".join(f"('{n}', {w}, {h}, {size}, {str(tiled).lower()}, {2 if n == 'planar' else 1})" for n, (w, h, size, tiled) in PLAIN.items())


@query(f"""WITH {FILES}, t AS (SELECT * FROM (VALUES {PLAIN_SQL}) t(variant, tw, th, size, tiled, planes)),
    s AS (SELECT *, unnest(range(0, ({WIDTH} + tw - 1) // tw)) AS seg_x FROM r JOIN t USING (variant)), q AS (SELECT *, unnest(range(0, (height + th - 1) // th)) AS seg_y FROM s), b AS (SELECT *, unnest(range(1, planes + 1)) AS plane FROM q)
    SELECT variant, raster, CASE WHEN planes > 1 THEN plane END::INT AS band, seg_x::BIGINT AS seg_x, seg_y::BIGINT AS seg_y, (seg_x * tw)::BIGINT AS x0, (seg_y * th)::BIGINT AS y0, least(tw, {WIDTH} - seg_x * tw)::BIGINT AS w,
        least(th, height - seg_y * th)::BIGINT AS h, (size * tw * CASE WHEN tiled THEN th ELSE least(th, height - seg_y * th) END)::BIGINT AS byte_count FROM b""")
def tiff_segments(spark, sf_dir):
    """Strips and tiles of the uncompressed files, and their sizes in bytes."""
    table = images(spark, sf_dir).filter(F.split("name", "-")[0].isin(list(PLAIN)))
    return read(spark, folder(spark, table), "segments").select(*label(), "band", "seg_x", "seg_y", "x0", "y0", "w", "h", "byte_count")


@query(f"""WITH {FILES} SELECT raster, {37 * 4 * 8}::BIGINT AS requested_bytes, {8 * 100 * 8}::BIGINT AS fetched_bytes, 1::BIGINT AS request_count, {8 * 100 * 8}::DOUBLE / {37 * 4 * 8}::DOUBLE AS amplification FROM r WHERE variant = 'strips'""")
def tiff_read_stats(spark, sf_dir):
    """What a window of four lines in one strip of eight lines asks for and fetches."""
    path = folder(spark, images(spark, sf_dir).filter("name LIKE 'strips%'"))
    return read(spark, path, "read_stats", window="20,1,37,4").select(label()[1], "requested_bytes", "fetched_bytes", "request_count", "amplification")


@query(f"WITH {FILES} SELECT variant, raster, (i // 32 * 32)::BIGINT AS x0, (j // th * th)::BIGINT AS y0, count(*) AS n, sum(value) AS total FROM p JOIN (VALUES ('tiles', 16), ('deflate', 32)) t(variant, th) USING (variant) GROUP BY ALL")
def tiff_chunks(spark, sf_dir):
    """Whole tiles as arrays."""
    path = folder(spark, images(spark, sf_dir).filter("name LIKE 'tiles%' OR name LIKE 'deflate%'"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return read(spark, path, "chunks", outputType="float64").select(*label(), "x0", "y0", F.size("samples").cast("long").alias("n"), total.alias("total"))


#: Files that are damaged or incomplete, made of a good one: name, what is done, code, severity and plugin code.
FAULTS = [
    ("signature", lambda b: b"XX" + b[2:], "InvalidSignature", "Error", "GTIF001"),
    ("version", lambda b: b[:2] + b"\x07\x00" + b[4:], "UnsupportedVersion", "Error", "GTIF002"),
    ("short", lambda b: b[:5], "TruncatedHeader", "Error", "GTIF001"),
    ("directory", lambda b: b[:4] + b"\xff\xff\xff\x7f" + b[8:], "TruncatedData", "Error", "GTIF003"),
    ("chain", lambda b: b[:4] + bytes(4) + b[8:], "InvalidOffset", "Error", "GTIF003"),
    ("cut", lambda b: b[:-100], "TruncatedData", "Error", "GTIF003"),
]
WRITTEN = [
    ("anchorless", {"anchor": None}, "UnknownPixelAnchor", "Warning", "GTIF009"),
    ("conflict", {"matrix": [5.0, 0, 0, 1000.0, 0, -5.0, 0, 2000.0, 0, 0, 0, 0, 0, 0, 0, 1.0]}, "ConflictingGeoTransform", "Warning", "GTIF007"),
    ("singular", {"scale": None, "matrix": [1.0, 2.0, 0, 0, 2.0, 4.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1.0]}, "InvalidGeoTransform", "Error", "GTIF008"),
    ("nodata", {"nodata": "none"}, "InvalidNoDataValue", "Error", "GTIF018"),
    ("codec", {"extra": [(259, "H", [7])]}, "UnsupportedCompression", "Error", "GTIF004"),
    ("planes", {"extra": [(284, "H", [3])]}, "UnsupportedPlanarConfiguration", "Error", "GTIF005"),
    ("bits", {"extra": [(258, "H", [12])]}, "UnsupportedSampleFormat", "Error", "GTIF005"),
    ("sizeless", {"drop": (256,)}, "InvalidRasterSize", "Error", "GTIF003"),
    ("offsetless", {"drop": (273,)}, "InconsistentTileLayout", "Error", "GTIF003"),
    ("scaleless", {"drop": (33922,)}, "InvalidGeoTransform", "Error", "GTIF008"),
]


def _faulty(raster: str, grid: np.ndarray):
    data = grid[:, :, 0].astype("f4")
    good = tiff(data, rows=8)
    for name, damage, *_ in FAULTS:
        yield f"{name}-{raster}.tif", damage(good)
    for name, how, *_ in WRITTEN:
        yield f"{name}-{raster}.tif", tiff(data, rows=8, **how)


_FAULTS_SQL = ", ".join(f"('{n}', '{code}', '{severity}', '{plugin}')" for n, _, code, severity, plugin in FAULTS + WRITTEN)


@query(f"SELECT variant, raster, 0::INT AS seq, code, severity, plugin_code FROM (VALUES {_FAULTS_SQL}) t(variant, code, severity, plugin_code), (SELECT DISTINCT event_id // {WIDTH * LINES} AS raster FROM events)")
def tiff_diagnostics(spark, sf_dir):
    """What is found wrong with files that are damaged, incomplete or of another kind."""
    table = sink.images(samples(spark, sf_dir), WIDTH, _faulty)
    return read(spark, folder(spark, table), "diagnostics").select(*label(), "seq", "code", "severity", "plugin_code")


#: Arguments of a request, for each customer one of these, and the code of the first fault.
REQUESTS = [
    ({}, "ok"),
    ({"representation": "mesh", "band": "2", "heightScale": "2.5"}, "ok"),
    ({"colour": "red"}, "UnknownFormatArgument"),
    ({"representation": "points"}, "UnsupportedFormatArgument"),
    ({"band": "0"}, "InvalidFormatArgument"),
    ({"band": "+1"}, "InvalidFormatArgument"),
    ({"pixelAnchor": "corner"}, "InvalidFormatArgument"),
    ({"heightScale": "2"}, "UnsupportedFormatArgument"),
    ({"representation": "mesh", "heightScale": "-1"}, "InvalidFormatArgument"),
    ({"representation": "mesh", "heightOffset": "nan"}, "InvalidFormatArgument"),
    ({"representation": "mesh", "nodata": "fill"}, "InvalidFormatArgument"),
    ({"representation": "mesh", "nodata": "fill", "fillValue": "0"}, "ok"),
    ({"representation": "mesh", "nodata": "keep", "fillValue": "0"}, "ConflictingFormatArguments"),
]


def _code(asked: dict[str, str]) -> str:
    try:
        args.parse(asked)
        return "ok"
    except RasterError as error:
        return error.diagnostic.code.value


@query(f"SELECT c_custkey AS k, list_value({', '.join(repr(c) for _, c in REQUESTS)})[(c_custkey % {len(REQUESTS)} + 1)::INT] AS code FROM customer")
def argument_rules(spark, sf_dir):
    """The rules for arguments, applied to a request of each customer."""
    from pyspark.sql.types import StringType

    check = F.udf(_code, StringType())
    asked = F.array(*[F.map_from_arrays(F.array(*map(F.lit, a)), F.array(*map(F.lit, a.values()))) if a else F.create_map().cast("map<string,string>") for a, _ in REQUESTS])
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), check(F.get(asked, (k % len(REQUESTS)).cast("int"))).alias("code"))
