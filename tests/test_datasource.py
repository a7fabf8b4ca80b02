import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from sparkgrid.raster import open_raster
from sparkgrid.sources import register
from sparkgrid.sources import tiff as tiffs
from sparkgrid.sources.bytesource import RecordingSource, open_source
from sparkgrid.sources.datasource import PushingReader, files_of, pixels_from_bytes, rasters_from_bytes
from tests.tiffs import ramp, tiff


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tiffs")
    files = {
        "strips.tif": tiff(ramp(8, 8), rows=2, scale=1.0),
        "tiles.TIFF": tiff(ramp(32, 32), tile=(16, 16), scale=1.0, compression=8),
        "two.tif": tiff(np.stack([[[10, 20], [30, 40]], [[110, 120], [130, 140]]], axis=2).astype("u2"), planar=2, rows=1),
        "missing.tif": tiff(np.array([[1, 2, 3], [4, -9999, 6], [7, 8, 9]], "f4"), nodata="-9999"),
        "over.tif": tiff(ramp(9, 9), overviews=[(1000 + np.arange(16)).reshape(4, 4).astype("u2")]),
        "gap.tif": tiff(ramp(8, 8), anchor=None),
        "note.txt": b"no raster",
    }
    for name, data in files.items():
        (path / name).write_bytes(data)
    (path / "bad.tif.part").write_bytes(b"XX*\0\x08\0\0\0")
    return path


def load(spark, path, **options):
    register(spark)
    return spark.read.format("geogrid").options(**options).load(str(path))


def test_files(folder):
    assert [f.rpartition("/")[2] for f in files_of([str(folder)])] == ["gap.tif", "missing.tif", "over.tif", "strips.tif", "tiles.TIFF", "two.tif"]


def test_rasters(spark, folder):
    rows = {r["source_label"]: r for r in load(spark, folder).collect()}
    assert len(rows) == 6
    assert (rows["tiles.TIFF"]["width"], rows["tiles.TIFF"]["native_tile"]["width"], rows["strips.tif"]["native_tile"]) == (32, 16, None)
    assert rows["two.tif"]["band_count"] == 2 and rows["gap.tif"]["pixel_anchor"] is None and rows["gap.tif"]["bounds"] is None
    assert rows["missing.tif"]["bands"][0]["nodata"] == -9999


def test_filters_prune_segments(spark, folder):
    everything = load(spark, folder / "strips.tif", relation="pixels")
    near = everything.filter("i >= 2 AND i < 5 AND j >= 1 AND j < 4")
    assert sorted(r["value"] for r in near.collect()) == [10, 11, 12, 18, 19, 20, 26, 27, 28]
    tiles = load(spark, folder / "tiles.TIFF", relation="pixels").filter("j = 20 AND i > 29")
    assert [(r["i"], r["value"]) for r in tiles.orderBy("i").collect()] == [(30, 670.0), (31, 671.0)]
    reader = PushingReader({"relation": "pixels", "path": str(folder / "tiles.TIFF")})
    assert len(list(reader.pushFilters([EqualTo(("j",), 20), GreaterThan(("i",), 29)]))) == 2
    (part,) = reader.partitions()
    assert part.low == {"i": 30, "j": 20} and part.high == {"i": None, "j": 20}
    source = RecordingSource(open_source(str(folder / "tiles.TIFF")))
    container = tiffs.Container(source)
    planned = tiffs.plan(container, reader.window(container), reader.read_options())
    assert planned.batches == [[3]]


def test_without_pushdown(spark, folder):
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        got = spark.read.format("geogrid").option("relation", "pixels").option("window", "2,1,3,3").option("pushdown", "false").load(str(folder / "strips.tif"))
        assert got.filter("i >= 3").count() == 6
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_options(spark, folder):
    strips = folder / "strips.tif"
    stepped = load(spark, strips, relation="pixels", window="1,1,5,5", step="2")
    assert [r["value"] for r in stepped.orderBy("r", "c").collect()] == [9, 11, 13, 25, 27, 29, 41, 43, 45]
    assert load(spark, strips, relation="pixels", scanlines="3,2").count() == 16
    tile = load(spark, folder / "tiles.TIFF", relation="pixels", tile="1,1").agg(F.min("value"), F.max("value")).first()
    assert tuple(tile) == (528.0, 1023.0)
    band = load(spark, folder / "two.tif", relation="pixels").filter("band = 2")
    assert sorted(r["value"] for r in band.collect()) == [110, 120, 130, 140]
    stats = load(spark, strips, relation="read_stats", window="2,1,3,3").first()
    assert (stats["requested_bytes"], stats["fetched_bytes"], stats["request_count"]) == (18, 64, 1)
    assert load(spark, strips, relation="segments").count() == 4
    chunk = load(spark, strips, relation="chunks").orderBy("y0").first()
    assert (chunk["w"], chunk["h"], chunk["samples"]) == (8, 2, [float(v) for v in range(16)])


def test_samples_beyond_an_overview_are_null(spark, folder):
    got = load(spark, folder / "over.tif", relation="pixels", step="2").collect()
    assert len(got) == 25 and sum(r["value"] is None for r in got) == 9


def test_diagnostics(spark, folder):
    rows = load(spark, folder / "gap.tif", relation="diagnostics").collect()
    assert [(r["code"], r["severity"], r["plugin_code"]) for r in rows] == [("UnknownPixelAnchor", "Warning", "GTIF009")]
    rows = load(spark, folder / "bad.tif.part", relation="diagnostics").collect()
    assert [(r["code"], r["severity"]) for r in rows] == [("InvalidSignature", "Error")]
    rows = load(spark, folder / "strips.tif", relation="diagnostics", window="6,6,3,3").collect()
    assert rows[0]["code"] == "WindowOutOfBounds" and rows[0]["window"]["x"] == 6


def test_stores_that_only_spark_reads(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder / "strips.tif"))
    assert rasters_from_bytes(files).first()["width"] == 8
    assert pixels_from_bytes(files).agg(F.sum("value")).first()[0] == sum(range(64))


def test_open_mesh(spark, folder):
    made = open_raster(spark, str(folder / "missing.tif"), {"representation": "mesh"})
    points = made["vertices"].orderBy("vertex_id").collect()
    assert len(points) == 9 and points[4]["source_z"] == 0.0 and points[4]["is_nodata"]
    assert made["faces"].count() == 0
    assert made["metadata"].first()["raster:noDataValue"] == -9999
    kept = open_raster(spark, str(folder / "missing.tif"), {"representation": "mesh", "nodata": "fill", "fillValue": "5"})
    assert [tuple(r) for r in kept["faces"].orderBy("face_id").limit(1).collect()] == [(0, 0, 3, 4, 1)]
    assert made["extent"].first()["max_y"] == kept["extent"].first()["max_y"]


def test_open_metadata(spark, folder):
    from sparkgrid.diagnostics import Code, RasterError

    with pytest.raises(RasterError) as error:
        open_raster(spark, str(folder / "gap.tif"))
    assert error.value.diagnostic.code is Code.MissingGeoreference
    row = open_raster(spark, str(folder / "gap.tif"), {"pixelAnchor": "point"})["metadata"].first()
    assert (row["raster:pixelAnchor"], row["raster:pixelAnchorSource"], row["geo:crs"]) == ("point", "argument", "EPSG:32654")
    with pytest.raises(RasterError) as error:
        open_raster(spark, str(folder / "strips.tif"), {"pixelAnchor": "area"})
    assert error.value.diagnostic.code is Code.ConflictingFormatArguments


def test_open_with_level_window_and_tiles(spark, tmp_path):
    from sparkgrid.diagnostics import RasterError
    from sparkgrid.operators.grid import Window

    (tmp_path / "wide.tif").write_bytes(tiff(ramp(160, 140), tile=(32, 32), compression=8, epsg=0))
    path, ask = str(tmp_path / "wide.tif"), {"representation": "mesh", "nodata": "keep"}
    coarse = open_raster(spark, path, ask, lod="balanced")
    assert coarse["vertices"].count() == 40 * 35 and coarse["faces"].count() == 39 * 34
    assert coarse["conversion"].first()["sampling_step"] == 4
    some = open_raster(spark, path, ask, part=Window(10, 20, 5, 3))["vertices"].orderBy("vertex_id").collect()
    assert [r["source_z"] for r in some] == [float(160 * j + i) for j in (20, 21, 22) for i in range(10, 15)]
    made = open_raster(spark, path, ask, tile_size=64, epsg=32654)
    tiles = {(r["tile_x"], r["tile_y"]): r["vertex_count"] for r in made["tiles"].collect()}
    assert tiles == {(x, y): w * h for x, w in enumerate((65, 65, 32)) for y, h in enumerate((65, 65, 12))}
    assert made["metadata"].first()["geo:crs"] == "EPSG:32654"
    # At full density tiles hold the vertices of the whole, those on shared edges more than once.
    assert sum(tiles.values()) == 160 * 140 + 2 * 140 + 2 * 160 + 4
    for wrong in ({"lod": "best"}, {"tile_size": 48}, {"part": Window(150, 0, 20, 5)}, {"part": Window(0, 0, 0, 5)}):
        with pytest.raises(RasterError):
            open_raster(spark, path, ask, **wrong)


def test_large_files_are_shared_out(spark, tmp_path, monkeypatch):
    from sparkgrid.sources import datasource

    monkeypatch.setattr(datasource, "TASK_BYTES", 1 << 12)
    for n in range(3):
        (tmp_path / f"r{n}.tif").write_bytes(tiff(ramp(64, 64 if n else 200), rows=4))
    reader = datasource.Reader({"relation": "pixels", "path": str(tmp_path)})
    parts = reader.partitions()
    assert max(n for p in parts for _, _, n in p.shares) > 2
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 64 * (200 + 64 + 64)
    headers = datasource.Reader({"relation": "rasters", "path": str(tmp_path)})
    assert [len(p.shares) for p in headers.partitions()] == [3]


def test_store_sources(tmp_path):
    from sparkgrid.diagnostics import RasterError
    from sparkgrid.sources.bytesource import Status, StoreSource

    (tmp_path / "a.bin").write_bytes(bytes(range(100)))
    source = StoreSource(f"file://{tmp_path}/a.bin")
    assert source.size() == 100 and source.read(10, 5) == (Status.ok, bytes(range(10, 15)))
    assert source.read(98, 5) == (Status.short_read, bytes([98, 99])) and source.read(101, 1) == (Status.end_of_source, b"")
    with pytest.raises(RasterError):
        StoreSource(f"file://{tmp_path}/none.bin")


def test_tile_edges_and_tiles_of_a_folder(spark, tmp_path):
    from sparkgrid.operators import tiling

    frame = spark.range(9 * 9).select((F.col("id") % 9).alias("c"), F.expr("id div 9").alias("r"), F.lit(0).alias("level"))
    tiling.write_tiles(tiling.shared_edges(frame, 4, 9, 9), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("level = 0 AND tile_x = 1 AND tile_y = 0").count() == 25
    assert back.select("c", "r").distinct().count() == 81 and back.count() == 100
