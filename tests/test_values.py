"""Arguments, diagnostics, keys, and expressions by numbers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sparkgrid import args
from sparkgrid.diagnostics import PLUGIN_CODES, Code, RasterError, Sink
from sparkgrid.functions import affine, bounds, types, values, windows
from sparkgrid.operators import cache, mesh, ranges, tiling
from sparkgrid.operators.grid import Window, choose_overview, factor_of


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_arguments():
    got = args.parse({"band": "02", "fillValue": "-1.5", "heightScale": "2.0", "nodata": "fill", "representation": "mesh"})
    assert (got.band, got.fill_value, got.height_scale, got.nodata) == (2, -1.5, 2.0, "fill")
    assert args.parse({"representation": "mesh"}, metadata_only=True).representation == "metadata"


@pytest.mark.parametrize(
    ("values", "code"),
    [
        ({"band": "0"}, Code.InvalidFormatArgument),
        ({"band": "1.0"}, Code.InvalidFormatArgument),
        ({"band": "4294967296"}, Code.InvalidFormatArgument),
        ({"representation": "mesh", "heightScale": "0"}, Code.InvalidFormatArgument),
        ({"representation": "mesh", "heightScale": "inf"}, Code.InvalidFormatArgument),
        ({"representation": "mesh", "heightScale": "1 "}, Code.InvalidFormatArgument),
        ({"representation": "mesh", "fillValue": "1"}, Code.ConflictingFormatArguments),
        ({"representation": "mesh", "nodata": "fill"}, Code.InvalidFormatArgument),
        ({"nodata": "keep"}, Code.UnsupportedFormatArgument),
        ({"representation": "cloud"}, Code.UnsupportedFormatArgument),
        ({"pixelAnchor": "centre"}, Code.InvalidFormatArgument),
        ({"colour": "red"}, Code.UnknownFormatArgument),
    ],
)
def test_rejected_arguments(values, code):
    with pytest.raises(RasterError) as error:
        args.parse(values)
    assert error.value.diagnostic.code is code


def test_anchors_and_limits():
    assert args.resolve_anchor("area", None) == ("area", "file")
    assert args.resolve_anchor(None, "point") == ("point", "argument")
    assert args.resolve_epsg(None, 4326) == 4326
    for wrong in (lambda: args.resolve_anchor("area", "area"), lambda: args.resolve_anchor(None, None), lambda: args.resolve_epsg(1, 2), lambda: args.check_ceiling(2049, 2048), lambda: args.lod_step("BALANCED"), lambda: tiling.check_tile_size(96)):
        with pytest.raises(RasterError):
            wrong()
    args.check_ceiling(2048, 2048)
    tiling.check_tile_size(64)
    assert args.lod_step("balanced") == 4
    assert args.can_read("a/B.TiF") and not args.can_read("tif") and not args.can_read("a.tif.gz")
    assert args.safe_label("https://host/dir/a.tif?key=secret#x") == "a.tif" and args.safe_label("dir/") == "raster asset"


def test_diagnostics(spark):
    assert len(Code) == 33 and set(PLUGIN_CODES.values()) == {f"GTIF{n:03}" for n in range(1, 20)}
    sink = Sink()
    sink.warn(Code.LossyConversion, "lossy", band=2)
    assert not sink.has_error
    with pytest.warns(UserWarning, match="GTIF015"):
        assert sink.report("a.tif")
    sink.fail(Code.Cancelled, "stopped", window=(1, 2, 3, 4))
    rows = sink.frame(spark, "a").collect()
    assert [(r["code"], r["plugin_code"], r["band"]) for r in rows] == [("LossyConversion", "GTIF015", 2), ("Cancelled", "GTIF017", None)]
    with pytest.warns(UserWarning), pytest.raises(RasterError):
        sink.report("a.tif")


def test_mesh_of_four(spark):
    rows = [(0, 0, 10.0), (1, 0, 20.0), (0, 1, 30.0), (1, 1, 40.0)]
    samples = spark.createDataFrame(rows, "i long, j long, value double").selectExpr("i", "j", "i AS c", "j AS r", "value", "false AS is_nodata")
    gt = affine.transform(1000000.25, 2.0, 0.0, 2000000.25, 0.0, -3.0)

    def points(anchor):
        flat = affine.window_bounds(gt, F.lit(anchor), windows.window(0, 0, 2, 2))
        return [(p["x"], p["y"], p["z"]) for p in mesh.vertices(samples, 2, gt, F.lit(anchor), flat).orderBy("vertex_id").collect()]

    area = points("area")
    assert (area[0], area[3]) == ((-0.75, -15.0, -1.75), (1.25, 15.0, 1.25))
    assert points("point")[0] == (-0.75, -15.0, -1.25)
    assert [tuple(f) for f in mesh.faces(spark, 2, 2).collect()] == [(0, 0, 2, 3, 1)]
    assert [tuple(f) for f in mesh.faces(spark, 2, 2, reverse=False).collect()] == [(0, 0, 1, 3, 2)]
    holed = samples.withColumn("is_nodata", F.expr("i = 1 AND j = 1"))
    assert mesh.faces(spark, 2, 2, holed).count() == 0
    assert mesh.ranked_faces(mesh.faces(spark, 5, 4)).orderBy("position").select("position").collect()[-1][0] == 11
    with pytest.raises(RasterError):
        mesh.faces(spark, 1 << 16, 1 << 16)


def test_affine(spark):
    gt = affine.transform(300000.0, 2.0, 0.0, 4400000.0, 0.0, -2.0)
    x, y = affine.pixel_to_source(gt, F.lit("area"), F.lit(1), F.lit(2))
    i, j = affine.source_to_pixel(gt, F.lit("area"), x, y, F.lit(8), F.lit(8))
    out, _ = affine.source_to_pixel(gt, F.lit("area"), F.lit(299999.0), y, F.lit(8), F.lit(8))
    none, _ = affine.pixel_to_source(gt, F.lit(None).cast("string"), F.lit(1), F.lit(2))
    flat = affine.transform(0.0, 1.0, 1.0, 0.0, 1.0, 1.0)
    got = one(spark, x, y, i, j, out, none, affine.is_invertible(flat), affine.inverse(flat, x, y)[0], affine.is_north_up(gt))
    assert tuple(got) == (300003.0, 4399995.0, 1, 2, None, None, False, None, True)


def test_windows(spark):
    big = windows.window(windows.MOST - 1, 0, 5, windows.MOST)
    got = one(spark, windows.end_x(big), windows.pixel_count(big), windows.to_overview(windows.window(3, 5, 4, 4), 4), windows.to_overview(windows.window(3, 5, 0, 4), 1), windows.equal(windows.window(1, 2, 0, 3), windows.window(9, 9, 4, 0)))
    assert (got[0], got[1], tuple(got[2]), got[4]) == (windows.MOST, windows.MOST, (0, 1, 2, 2), True)
    tiles = one(spark, windows.subdivide(windows.window(1, 1, 5, 3), 4, 2))[0]
    assert [tuple(t) for t in tiles] == [(1, 1, 4, 2), (5, 1, 1, 2), (1, 3, 4, 1), (5, 3, 1, 1)]
    assert one(spark, windows.subdivide(windows.window(1, 1, 0, 3), 4, 2))[0] == []
    assert choose_overview(64, [32, 16, 40], 4) == 2 and choose_overview(64, [32], 1) is None and factor_of(9, 4) == 2
    assert Window(0, 0, 5, 5).sampled(2) == (3, 3) and not Window(6, 0, 3, 1).inside(8, 8)


def test_values(spark):
    nan, inf = F.lit(math.nan), F.lit(math.inf)
    got = one(spark, values.converted(nan, "uint8"), values.converted(inf, "uint8"), values.converted(F.lit(-3.7), "uint8"), values.converted(F.lit(-3.7), "int16"), values.converted(F.lit(9e9), "uint32"), values.converted(F.lit(0.1), "float32"))
    assert tuple(got) == (0.0, 0.0, 0.0, -3.0, 4294967295.0, 0.10000000149011612)
    none = F.lit(None).cast("double")
    got = one(spark, values.matches_nodata(nan, nan), values.matches_nodata(F.lit(-0.0), F.lit(0.0)), values.matches_nodata(nan, none), values.same_nodata(none, none), values.scaled(F.lit(-0.0), none, none))
    assert tuple(got)[:4] == (True, True, False, True) and math.copysign(1, got[4]) == -1
    assert sum(types.exactly_representable(a, b) for a in types.SAMPLE_TYPES for b in types.SAMPLE_TYPES) == 28
    with pytest.raises(ValueError, match="policy"):
        values.elevation(F.lit(1.0), F.lit(True), "drop")


def test_bounds(spark):
    b = bounds.bounds(0.0, 0.0, 0.0, 5.0, -0.0, 3.0)
    odd = bounds.bounds(1.0, 0.0, 0.0, 0.0, 1.0, 1.0)
    got = one(spark, *[bounds.local_origin(b, a) for a in "xyz"], bounds.local_origin(b, "x", 0.0), bounds.local_origin(odd, "x"), bounds.half_away(F.lit(-2.5)), bounds.half_away(F.lit(2.0**53 + 2)))
    assert tuple(got) == (3.0, 0.0, 2.0, 2.5, 0.0, -3.0, 2.0**53 + 2)
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (math.inf, 0.0, 0.0), (0.0, 5.0, 1.0)], "x double, y double, z double")
    assert tuple(rows.agg(bounds.expand(F.col("x"), F.col("y"), F.col("z")).alias("b")).first()[0]) == (0.0, 2.0, 1.0, 1.0, 5.0, 3.0)
    assert rows.limit(0).agg(bounds.expand(F.col("x"), F.col("y"), F.col("z")).alias("b")).first()[0] is None


def naive_digest(message: bytes) -> str:
    low, high = cache.LOW_START, cache.HIGH_START
    for byte in message:
        low, high = (low ^ byte) * cache.LOW_FACTOR % 2**64, (high ^ byte) * cache.HIGH_FACTOR % 2**64
    return f"{high:016x}{low:016x}"


def test_cache_keys(spark):
    parts = [("s", "abé"), ("u", 2**64 - 1), ("i", -1), ("b", True), ("d", 1.5), ("u", None)]
    assert cache.hex_digest(parts) == naive_digest(b"".join(cache.encode_part(k, v) for k, v in parts))
    assert cache.hex_digest([]) == naive_digest(b"")
    assert cache.hex_digest([("d", -0.0)]) == cache.hex_digest([("d", 0.0)])
    assert cache.hex_digest([("d", float("nan"))]) == cache.hex_digest([("d", -float("nan"))])
    assert cache.hex_digest([("s", "a"), ("s", "b")]) != cache.hex_digest([("s", "ab"), ("s", "")])
    rows = spark.createDataFrame([(1, None, 1, "float32"), (2, 3, 4, "uint8")], "b long, l long, s long, t string")
    got = [r[0] for r in rows.select(cache.read_key(*[F.col(c) for c in "blst"])).collect()]
    assert got == [cache.hex_digest([("u", 1), ("u", None), ("u", 1), ("s", "float32")]), cache.hex_digest([("u", 2), ("u", 3), ("u", 4), ("s", "uint8")])]
    mixed = [("é" * 3, -5, True, -0.0), (None, None, None, None), ("", 2**62, False, float("nan"))]
    frame = spark.createDataFrame(mixed, "s string, i long, b boolean, d double")
    assert [r[0] for r in frame.select(cache.cache_key("sibd", *[F.col(c) for c in "sibd"])).collect()] == [cache.hex_digest(list(zip("sibd", row))) for row in mixed]
    low = one(spark, cache.tile_hash(F.lit(1), F.lit(2), F.lit(3)))[0]
    assert f"{low % 2**64:016x}" == cache.hex_digest([("u", 1), ("u", 2), ("u", 3)])[16:]


def test_ranges(spark):
    rows = spark.createDataFrame([("a", 0, 3), ("a", 2, 3), ("a", 1, 1), ("a", 9, 0), ("b", 5, 5)], "raster_id string, offset long, length long")
    assert {r[0]: r[1] for r in ranges.distinct_bytes(rows).collect()} == {"a": 5, "b": 5}
    parts = spark.createDataFrame([("a", k, 100 + 30 * k + (k > 2), 30) for k in range(5)], "raster_id string, ordinal long, byte_offset long, byte_count long")
    got = sorted(tuple(r)[1:] for r in ranges.coalesced(parts, most=64).collect())
    assert got == [(100, 60, 2), (160, 30, 1), (191, 60, 2)]


def test_tiles_and_levels(spark):
    assert tiling.level_sizes(100, 40, 32) == [(0, 100, 40), (1, 50, 20), (2, 25, 10)]
    grid = spark.range(65 * 65).selectExpr("id % 65 AS c", "id div 65 AS r", "0 AS level")
    counts = {(r["tile_x"], r["tile_y"]): r["vertex_count"] for r in tiling.manifest(tiling.shared_edges(grid, 32, 65, 65), 32).collect()}
    assert counts == {(x, y): 1089 for x in range(2) for y in range(2)}
    untiled = tiling.shared_edges(grid, 32, 65, 65).select("c", "r").distinct().count()
    assert untiled == 65 * 65


def test_planned_contracts(spark, tmp_path):
    base = dict(identity="a@1", arguments={"heightScale": "1", "band": "1"}, step=4, tile_size=None, policy="skip", origin=(1.0, 2.0, 0.0), versions={"reader": "1"})
    key = cache.conversion_key(**base)
    assert key == cache.conversion_key(**base | {"arguments": {"band": "1", "heightScale": "1.0"}})
    assert key != cache.conversion_key(**base | {"step": 5}) and key != cache.conversion_key(**base | {"tile_size": 64})
    with pytest.raises(RasterError):
        tiling.check_image([{"data_type": "uint16"}] * 3)
    tiling.check_image([{"data_type": "uint8"}] * 4)
    wide = one(spark, affine.scaled_degrees(affine.transform(139.0, 0.25, 0.0, 36.0, 0.0, -0.25), 100000.0))[0]
    assert (wide["a1"], wide["b2"]) == (25000.0, -25000.0)
    from sparkgrid.operators import metadata

    metadata.export(spark.range(1).selectExpr("id", "CAST(NULL AS STRING) AS gone"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").columns == ["id"]
