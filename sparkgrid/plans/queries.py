"""One query for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid import diagnostics
from sparkgrid.functions import affine, bounds, types, values, windows
from sparkgrid.operators import cache, grid, mesh, metadata, ranges, segments, tiling
from sparkgrid.operators.grid import Window
from sparkgrid.plans import rasters
from sparkgrid.plans.rasters import ANCHOR, NODATA, WIDTH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DEM = """dem AS (
    SELECT event_id % 100 AS i, event_id // 100 AS j, CASE WHEN event_type = 'error' THEN -9999.0::DOUBLE ELSE value END AS value,
        event_type = 'error' AS is_nodata FROM events
), size AS (
    SELECT 100 AS w, ceil(count(*) / 100.0)::BIGINT AS h FROM events
)"""
EMB = "emb AS (SELECT vec_id AS j, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings)"
NORTH_X, NORTH_Y = "(300000.25::DOUBLE + 2.0::DOUBLE * {px} + 0.0::DOUBLE * {py})", "(4400000.25::DOUBLE + 0.0::DOUBLE * {px} + (-2.0)::DOUBLE * {py})"
TURNED_X, TURNED_Y = "(300000.0::DOUBLE + 1.5::DOUBLE * {px} + 0.5::DOUBLE * {py})", "(4400000.0::DOUBLE + 0.25::DOUBLE * {px} + (-1.75)::DOUBLE * {py})"
CELL = {"px": "(i + 0.5::DOUBLE)", "py": "(j + 0.5::DOUBLE)"}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Reads -----------------------------------------------------------------------


@query(f"WITH {DEM} SELECT i, j, i - 20 AS c, j - 5 AS r, value FROM dem WHERE i >= 20 AND i < 57 AND j >= 5 AND j < 24")
def window_read(spark, sf_dir):
    return grid.read_window(rasters.dem(spark, sf_dir), Window(20, 5, 37, 19))


@query(f"WITH {DEM} SELECT i, j, (i - 1) // 3 AS c, (j - 1) // 3 AS r, value FROM dem, size WHERE i >= 1 AND j >= 1 AND j < h AND (i - 1) % 3 = 0 AND (j - 1) % 3 = 0")
def decimate(spark, sf_dir):
    height = rasters.dem_height(spark, sf_dir)
    return grid.read_window(rasters.dem(spark, sf_dir), Window(1, 1, WIDTH - 1, height - 1), step=3, size=(WIDTH, height))


@query(f"WITH {DEM} SELECT i, j, i AS c, j - 3 AS r, value FROM dem WHERE j >= 3 AND j < 8")
def scanline_read(spark, sf_dir):
    return grid.scanlines(rasters.dem(spark, sf_dir), 3, 5, WIDTH, rasters.dem_height(spark, sf_dir))


@query(f"WITH {DEM} SELECT i, j, i - 96 AS c, j AS r, value FROM dem WHERE i >= 96 AND j < 16")
def native_tile_read(spark, sf_dir):
    return grid.tile_at(rasters.dem(spark, sf_dir), 6, 0, 16, 16, WIDTH, rasters.dem_height(spark, sf_dir))


@query(f"WITH {EMB} SELECT i::BIGINT AS i, j, value FROM emb")
def band_array_scan(spark, sf_dir):
    return rasters.emb(spark, sf_dir)


@query(f"""WITH {DEM}, level AS (SELECT i // 2 AS i, j // 2 AS j, value FROM dem WHERE i % 2 = 0 AND j % 2 = 0),
    wanted AS (SELECT c, r, c * 3 AS i, r * 3 AS j FROM (SELECT unnest(range(0, 34)) AS c), (SELECT unnest(range(0, (h + 2) // 3)) AS r FROM size))
    SELECT w.c, w.r, w.i, w.j, level.value FROM wanted w JOIN level ON level.i = w.i // 2 AND level.j = w.j // 2""")
def overview_read(spark, sf_dir):
    pixels, height = rasters.dem(spark, sf_dir), rasters.dem_height(spark, sf_dir)
    level = grid.choose_overview(WIDTH, [WIDTH // 2], step=3)
    factor = grid.factor_of(WIDTH, [WIDTH // 2][level])
    return grid.read_overview(grid.build_overview(pixels, factor), Window(0, 0, WIDTH, height), factor, 3).select("c", "r", "i", "j", "value")


@query(f"WITH {EMB}, k AS (SELECT i::BIGINT AS i, j, value * 0.5::DOUBLE + 100.0::DOUBLE AS v FROM emb) SELECT i, j, v AS value, v::FLOAT::DOUBLE = 100.25::DOUBLE AS is_nodata FROM k WHERE false UNION ALL SELECT i, j, v::FLOAT::DOUBLE, v::FLOAT::DOUBLE = 100.25::DOUBLE FROM k")
def scaled_read(spark, sf_dir):
    return grid.decode(rasters.emb(spark, sf_dir), F.lit(0.5), F.lit(100.0), "float32", nodata=100.25)


def _convert(name: str, low: float, high: float):
    sql = f"WITH {DEM}, v AS (SELECT i, j, value * 7.3::DOUBLE - 40.0::DOUBLE AS v FROM dem) SELECT i, j, trunc(least(greatest(v, {low}::DOUBLE), {high}::DOUBLE)) + 0.0::DOUBLE AS value FROM v"

    def run(spark, sf_dir):
        v = F.col("value") * F.lit(7.3) - F.lit(40.0)
        return rasters.dem(spark, sf_dir).select("i", "j", values.converted(v, name).alias("value"))

    run.__name__ = f"convert_{name}"
    query(sql)(run)


for _t in types.SAMPLE_TYPES.values():
    if _t.range:
        _convert(_t.name, *map(float, _t.range))


@query(f"WITH {DEM} SELECT i, j, (value / 3.0::DOUBLE)::FLOAT::DOUBLE AS value FROM dem")
def convert_float32(spark, sf_dir):
    return rasters.dem(spark, sf_dir).select("i", "j", values.converted(F.col("value") / F.lit(3.0), "float32").alias("value"))


@query(f"WITH {DEM} SELECT i, j, value / 3.0::DOUBLE AS value FROM dem")
def convert_float64(spark, sf_dir):
    return rasters.dem(spark, sf_dir).select("i", "j", values.converted(F.col("value") / F.lit(3.0), "float64").alias("value"))


@query("""WITH t(name, size, floating, signed) AS (VALUES ('uint8', 1, false, false), ('int8', 1, false, true), ('uint16', 2, false, false), ('int16', 2, false, true),
        ('uint32', 4, false, false), ('int32', 4, false, true), ('float32', 4, true, true), ('float64', 8, true, true))
    SELECT a.name AS source_type, b.name AS target_type, CASE WHEN a.name = b.name OR b.name = 'float64' THEN true
        WHEN b.name = 'float32' THEN a.size <= 2 WHEN a.floating THEN false WHEN a.signed = b.signed THEN b.size >= a.size
        WHEN a.signed THEN false ELSE b.size > a.size END AS exact FROM t a, t b""")
def representability(spark, sf_dir):
    return types.representability(spark)


# Georeferencing ----------------------------------------------------------------


@query(f"WITH {DEM} SELECT i, j, {TURNED_X.format(**CELL)} AS x, {TURNED_Y.format(**CELL)} AS y FROM dem")
def pixel_to_source(spark, sf_dir):
    x, y = affine.pixel_to_source(rasters.gt(True), F.lit(ANCHOR), F.col("i"), F.col("j"))
    return rasters.dem(spark, sf_dir).select("i", "j", x.alias("x"), y.alias("y"))


@query(f"WITH {DEM} SELECT i, j, {TURNED_X.format(px='i', py='j')} AS x, {TURNED_Y.format(px='i', py='j')} AS y, NULL::DOUBLE AS x_unknown FROM dem")
def pixel_to_source_point(spark, sf_dir):
    x, y = affine.pixel_to_source(rasters.gt(True), F.lit("point"), F.col("i"), F.col("j"))
    unknown, _ = affine.pixel_to_source(rasters.gt(True), F.lit(None).cast("string"), F.col("i"), F.col("j"))
    return rasters.dem(spark, sf_dir).select("i", "j", x.alias("x"), y.alias("y"), unknown.alias("x_unknown"))


DET = "(1.5::DOUBLE * (-1.75)::DOUBLE - 0.5::DOUBLE * 0.25::DOUBLE)"


@query(f"""WITH {DEM}, p AS (SELECT event_id, 300000.0::DOUBLE + (event_id * 7 % 173)::DOUBLE AS x, 4400000.0::DOUBLE - (event_id * 5 % 191)::DOUBLE AS y FROM events),
    q AS (SELECT event_id, floor(((-1.75)::DOUBLE * (x - 300000.0::DOUBLE) - 0.5::DOUBLE * (y - 4400000.0::DOUBLE)) / {DET} - 0.5::DOUBLE + 0.5::DOUBLE)::BIGINT AS i,
        floor((1.5::DOUBLE * (y - 4400000.0::DOUBLE) - 0.25::DOUBLE * (x - 300000.0::DOUBLE)) / {DET} - 0.5::DOUBLE + 0.5::DOUBLE)::BIGINT AS j FROM p)
    SELECT q.event_id, q.i, q.j, d.value FROM q JOIN dem d ON d.i = q.i AND d.j = q.j""")
def source_to_pixel(spark, sf_dir):
    e = F.col("event_id")
    points = rasters.events(spark, sf_dir).select("event_id", (F.lit(300000.0) + (e * 7 % 173)).alias("x"), (F.lit(4400000.0) - (e * 5 % 191)).alias("y"))
    found = grid.locate(points, rasters.dem(spark, sf_dir), rasters.gt(True), F.lit(ANCHOR), WIDTH, rasters.dem_height(spark, sf_dir))
    return found.select("event_id", "i", "j", "value")


@query(f"""WITH {DEM}, p AS (SELECT i, j, {TURNED_X.format(**CELL)} - 300000.0::DOUBLE AS dx, {TURNED_Y.format(**CELL)} - 4400000.0::DOUBLE AS dy FROM dem)
    SELECT i, j, ((-1.75)::DOUBLE * dx - 0.5::DOUBLE * dy) / {DET} AS px, (1.5::DOUBLE * dy - 0.25::DOUBLE * dx) / {DET} AS py FROM p""")
def inverse_roundtrip(spark, sf_dir):
    gt = rasters.gt(True)
    px, py = affine.inverse(gt, *affine.pixel_to_source(gt, F.lit(ANCHOR), F.col("i"), F.col("j")))
    return rasters.dem(spark, sf_dir).select("i", "j", px.alias("px"), py.alias("py"))


def _bounds_sql(less: int) -> str:
    at = lambda f, x, y: f.format(px=f"{x}::DOUBLE", py=f"{y}::DOUBLE")
    xs, ys = ("x", f"(x + w - {less})"), ("y", f"(y + h - {less})")
    east = ", ".join(at(TURNED_X, x, y) for y in ys for x in xs)
    north = ", ".join(at(TURNED_Y, x, y) for y in ys for x in xs)
    return f"""WITH win AS (SELECT event_id, event_id % 90 AS x, event_id % 7 AS y, event_id % 11 AS w, event_id % 5 AS h FROM events)
        SELECT event_id, CASE WHEN w > 0 AND h > 0 THEN least({east}) END AS min_x, CASE WHEN w > 0 AND h > 0 THEN least({north}) END AS min_y,
        CASE WHEN w > 0 AND h > 0 THEN greatest({east}) END AS max_x, CASE WHEN w > 0 AND h > 0 THEN greatest({north}) END AS max_y FROM win"""


def _some_windows(spark, sf_dir):
    e = F.col("event_id")
    return rasters.events(spark, sf_dir).select("event_id", windows.window(e % 90, e % 7, e % 11, e % 5).alias("win"))


def _window_bounds(spark, sf_dir, anchor):
    b = affine.window_bounds(rasters.gt(True), F.lit(anchor), F.col("win"))
    return _some_windows(spark, sf_dir).select("event_id", *[b[n].alias(n) for n in ("min_x", "min_y", "max_x", "max_y")])


@query(_bounds_sql(0))
def window_bounds_area(spark, sf_dir):
    return _window_bounds(spark, sf_dir, "area")


@query(_bounds_sql(1))
def window_bounds_point(spark, sf_dir):
    return _window_bounds(spark, sf_dir, "point")


@query("""WITH g AS (SELECT s_suppkey AS k, (s_suppkey % 5 - 2)::DOUBLE AS a1, (s_suppkey % 3)::DOUBLE AS a2, (s_suppkey % 2)::DOUBLE AS b1, (s_suppkey % 7 - 3)::DOUBLE AS b2 FROM supplier),
    d AS (SELECT *, a1 * b2 - a2 * b1 AS det, abs(a1) + abs(a2) + abs(b1) + abs(b2) AS s FROM g)
    SELECT k, det AS determinant, det <> 0 AND abs(det) > s * s * 1e-15::DOUBLE AS invertible, a2 <> 0 OR b1 <> 0 AS rotated,
        NOT (a2 <> 0 OR b1 <> 0) AND a1 > 0 AND b2 < 0 AS north_up, NOT (a2 <> 0 OR b1 <> 0) AND b2 > 0 AS south_up,
        sqrt(a1 * a1 + b1 * b1) AS pixel_width, sqrt(a2 * a2 + b2 * b2) AS pixel_height FROM d""")
def transform_properties(spark, sf_dir):
    k = F.col("s_suppkey")
    g = affine.transform(0.0, (k % 5 - 2).cast("double"), (k % 3).cast("double"), 0.0, (k % 2).cast("double"), (k % 7 - 3).cast("double"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("k"), g.alias("g")).select(
        "k", affine.determinant(F.col("g")).alias("determinant"), affine.is_invertible(F.col("g")).alias("invertible"), affine.is_rotated(F.col("g")).alias("rotated"),
        affine.is_north_up(F.col("g")).alias("north_up"), affine.is_south_up(F.col("g")).alias("south_up"),
        affine.pixel_width(F.col("g")).alias("pixel_width"), affine.pixel_height(F.col("g")).alias("pixel_height"),
    )


@query("""SELECT s_suppkey AS k, (s_suppkey % 50)::DOUBLE - 2.0::DOUBLE * 3.0::DOUBLE AS scale_a0, 2.0::DOUBLE AS scale_a1, 500.0::DOUBLE + 2.5::DOUBLE * 4.0::DOUBLE AS scale_b0, -2.5::DOUBLE AS scale_b2,
    s_suppkey::DOUBLE AS matrix_a0, 5.0::DOUBLE AS matrix_a1, -5.0::DOUBLE AS matrix_b2 FROM supplier""")
def transform_sources(spark, sf_dir):
    k = F.col("s_suppkey")
    scale = affine.from_scale_and_tiepoint(2.0, 2.5, 3.0, 4.0, (k % 50).cast("double"), 500.0)
    cells = [5.0, 0.0, 0.0, k.cast("double"), 0.0, -5.0, 0.0, 2000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    matrix = affine.from_matrix(F.array(*[c if not isinstance(c, float) else F.lit(c) for c in cells]))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.alias("k"), *[scale[t].alias(f"scale_{t}") for t in ("a0", "a1", "b0", "b2")], *[matrix[t].alias(f"matrix_{t}") for t in ("a0", "a1", "b2")]
    )


# Windows -------------------------------------------------------------------------

WIN = "win AS (SELECT event_id, event_id % 90 AS x, event_id % 7 AS y, event_id % 11 AS w, event_id % 5 AS h FROM events)"


@query(f"""WITH {WIN}, c AS (SELECT event_id, greatest(x, 10) AS x, greatest(y, 2) AS y, least(x + w, 60) - greatest(x, 10) AS w, least(y + h, 8) - greatest(y, 2) AS h, w > 0 AND h > 0 AS full_window FROM win)
    SELECT event_id, CASE WHEN full_window AND w > 0 AND h > 0 THEN x ELSE 0 END AS x, CASE WHEN full_window AND w > 0 AND h > 0 THEN y ELSE 0 END AS y,
        CASE WHEN full_window AND w > 0 AND h > 0 THEN w ELSE 0 END AS width, CASE WHEN full_window AND w > 0 AND h > 0 THEN h ELSE 0 END AS height FROM c""")
def clip_windows(spark, sf_dir):
    met = windows.intersect(F.col("win"), windows.window(10, 2, 50, 6))
    return _some_windows(spark, sf_dir).select("event_id", met.alias("met")).select("event_id", "met.*")


@query(f"""WITH {WIN} SELECT event_id, CASE WHEN w = 0 OR h = 0 THEN 0 ELSE x // 4 END AS x, CASE WHEN w = 0 OR h = 0 THEN 0 ELSE y // 4 END AS y,
    CASE WHEN w = 0 OR h = 0 THEN 0 ELSE (x + w + 3) // 4 - x // 4 END AS width, CASE WHEN w = 0 OR h = 0 THEN 0 ELSE (y + h + 3) // 4 - y // 4 END AS height FROM win""")
def to_overview(spark, sf_dir):
    return _some_windows(spark, sf_dir).select("event_id", windows.to_overview(F.col("win"), 4).alias("o")).select("event_id", "o.*")


@query(f"""WITH {WIN}, f AS (SELECT *, CASE WHEN w = 0 OR h = 0 THEN 1 ELSE 4 END AS k FROM win)
    SELECT event_id, x * k AS x, y * k AS y, w * k AS width, h * k AS height FROM f""")
def from_overview(spark, sf_dir):
    return _some_windows(spark, sf_dir).select("event_id", windows.from_overview(F.col("win"), 4).alias("o")).select("event_id", "o.*")


@query(f"""WITH {WIN} SELECT event_id, w > 0 AND h > 0 AND 40 >= x AND 40 < x + w AND 3 >= y AND 3 < y + h AS has_point,
    w = 0 OR h = 0 OR (x >= 10 AND y >= 2 AND x + w <= 60 AND y + h <= 8) AS inside, w * h AS pixels, (w + 2) // 3 AS sampled_width,
    (w = 0 OR h = 0) OR (x = 40 AND y = 5 AND w = 7 AND h = 0) AS equals_empty FROM win""")
def window_predicates(spark, sf_dir):
    w, box = F.col("win"), windows.window(10, 2, 50, 6)
    return _some_windows(spark, sf_dir).select(
        "event_id", windows.contains_point(w, 40, 3).alias("has_point"), windows.contains_window(box, w).alias("inside"),
        windows.pixel_count(w).alias("pixels"), windows.sampled_extent(w["width"], 3).alias("sampled_width"), windows.equal(w, windows.window(9, 9, 0, 3)).alias("equals_empty"),
    )


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 9223372036854775807 ELSE o_orderkey + 10 END AS end_x,
    CASE WHEN o_orderkey % 2 = 0 THEN 9223372036854775807 ELSE o_orderkey * 10 END AS pixels FROM orders""")
def saturating_windows(spark, sf_dir):
    k = F.col("o_orderkey")
    w = windows.window(F.when(k % 2 == 0, F.lit(windows.MOST - 3)).otherwise(k), 0, F.when(k % 2 == 0, F.lit(windows.MOST)).otherwise(F.lit(10)), F.when(k % 2 == 0, F.lit(5)).otherwise(k))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), windows.end_x(w).alias("end_x"), windows.pixel_count(w).alias("pixels"))


@query(f"""WITH {WIN} SELECT event_id, (x + c * 4)::BIGINT AS x, (y + r * 2)::BIGINT AS y, least(4, w - c * 4)::BIGINT AS width, least(2, h - r * 2)::BIGINT AS height
    FROM (SELECT *, unnest(range(0, (w + 3) // 4)) AS c FROM win), (SELECT unnest(range(0, 3)) AS r) WHERE r < (h + 1) // 2""")
def subdivide_tiles(spark, sf_dir):
    tiles = _some_windows(spark, sf_dir).select("event_id", F.explode(windows.subdivide(F.col("win"), 4, 2)).alias("t"))
    return tiles.select("event_id", "t.*")


@query("SELECT event_id, CASE WHEN event_id % 60 = 0 THEN 0 ELSE (1000 + (event_id % 60) // 2) // (event_id % 60) END AS factor FROM events")
def overview_factors(spark, sf_dir):
    return rasters.events(spark, sf_dir).select("event_id", windows.overview_factor(1000, F.col("event_id") % 60).alias("factor"))


# Missing values and meshes -----------------------------------------------------------


@query(f"WITH {DEM} SELECT i, j, value, is_nodata FROM dem")
def nodata_mask(spark, sf_dir):
    return rasters.dem_samples(spark, sf_dir).select("i", "j", "value", "is_nodata")


def _elevation(policy: str, base: str):
    def run(spark, sf_dir):
        z = values.elevation(F.col("value"), F.col("is_nodata"), policy, fill=7.5, scale=2.0, offset=-1.0)
        return rasters.dem_samples(spark, sf_dir).select("i", "j", z.alias("z"))

    run.__name__ = f"nodata_{policy}"
    query(f"WITH {DEM} SELECT i, j, 2.0::DOUBLE * CASE WHEN is_nodata THEN {base} ELSE value END + (-1.0)::DOUBLE AS z FROM dem")(run)


_elevation("skip", "0.0::DOUBLE")
_elevation("fill", "7.5::DOUBLE")
_elevation("keep", "value")


def _faces_sql(where: str) -> str:
    return f"""WITH {DEM}, q AS (SELECT r * 100 + c AS f FROM (SELECT unnest(range(0, 99)) AS c), (SELECT unnest(range(0, h - 1)) AS r FROM size))
        SELECT f AS face_id, f AS v0, f + 100 AS v1, f + 101 AS v2, f + 1 AS v3 FROM q {where}"""


@query(_faces_sql("WHERE NOT EXISTS (SELECT 1 FROM dem WHERE is_nodata AND j * 100 + i IN (f, f + 1, f + 100, f + 101))").replace(
    "WHERE NOT EXISTS (SELECT 1 FROM dem WHERE is_nodata AND j * 100 + i IN (f, f + 1, f + 100, f + 101))",
    "WHERE NOT EXISTS (SELECT 1 FROM (SELECT j * 100 + i - o AS hit FROM dem, (VALUES (0), (1), (100), (101)) t(o) WHERE is_nodata) WHERE hit = f)"))
def faces_skip(spark, sf_dir):
    missing = rasters.dem_samples(spark, sf_dir)
    return mesh.faces(spark, WIDTH, rasters.dem_height(spark, sf_dir), missing)


@query(_faces_sql(""))
def faces_keep(spark, sf_dir):
    return mesh.faces(spark, WIDTH, rasters.dem_height(spark, sf_dir))


HALF_AWAY = "(CASE WHEN ({v}) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * floor(abs({v}) + 0.5::DOUBLE))"
PLACED = f"""{DEM}, z AS (SELECT i, j, is_nodata, {NORTH_X.format(**CELL)} AS sx, {NORTH_Y.format(**CELL)} AS sy, 1.0::DOUBLE * CASE WHEN is_nodata THEN 0.0::DOUBLE ELSE value END + 0.0::DOUBLE AS sz FROM dem),
    span AS (SELECT min(sz) FILTER (NOT is_nodata) AS lo, max(sz) FILTER (NOT is_nodata) AS hi FROM z),
    box AS (SELECT 300000.25::DOUBLE AS x0, 300000.25::DOUBLE + 2.0::DOUBLE * 100 AS x1, 4400000.25::DOUBLE - 2.0::DOUBLE * h AS y0, 4400000.25::DOUBLE AS y1 FROM size),
    mid AS (SELECT x0 + (x1 - x0) * 0.5::DOUBLE AS mx, y0 + (y1 - y0) * 0.5::DOUBLE AS my, lo + (hi - lo) * 0.5::DOUBLE AS mz FROM box, span),
    origin AS (SELECT {HALF_AWAY.format(v='mx')} AS ox, {HALF_AWAY.format(v='my')} AS oy, {HALF_AWAY.format(v='mz')} AS oz FROM mid)"""


def _vertices(spark, sf_dir, policy="skip", **heights):
    height = rasters.dem_height(spark, sf_dir)
    return mesh.vertices(rasters.dem_samples(spark, sf_dir), WIDTH, rasters.gt(), F.lit(ANCHOR), rasters.flat_bounds(height), policy, **heights)


@query(f"WITH {PLACED} SELECT j * 100 + i AS vertex_id, sx AS source_x, sy AS source_y, sz AS source_z, (sx - ox)::FLOAT AS x, (sz - oz)::FLOAT AS y, (-(sy - oy))::FLOAT AS z, is_nodata FROM z, origin")
def mesh_vertices(spark, sf_dir):
    return _vertices(spark, sf_dir).select("vertex_id", "source_x", "source_y", "source_z", "x", "y", "z", "is_nodata")


@query(f"WITH {PLACED} SELECT lo AS min_z, hi AS max_z FROM span")
def elevation_range(spark, sf_dir):
    at = mesh.placed(rasters.dem_samples(spark, sf_dir), WIDTH, rasters.gt(), F.lit(ANCHOR))
    return mesh.elevation_range(at)


@query(f"WITH {PLACED} SELECT ox AS x, oy AS y, oz AS z FROM origin")
def local_origin(spark, sf_dir):
    at = mesh.placed(rasters.dem_samples(spark, sf_dir), WIDTH, rasters.gt(), F.lit(ANCHOR))
    return mesh.origin_row(mesh.mesh_bounds(rasters.flat_bounds(rasters.dem_height(spark, sf_dir)), mesh.elevation_range(at)))


@query(f"""WITH {PLACED}, p AS (SELECT (sx - ox)::FLOAT AS x, (sz - oz)::FLOAT AS y, (-(sy - oy))::FLOAT AS z FROM z, origin)
    SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM p""")
def mesh_extent(spark, sf_dir):
    return mesh.extent(_vertices(spark, sf_dir))


@query("SELECT 'mesh' AS representation, 4::INT AS sampling_step, 2.0::DOUBLE AS height_scale, 0.0::DOUBLE AS height_offset, 'fill' AS nodata_policy, 7.5::DOUBLE AS fill_value, 'rightHanded' AS orientation, 'none' AS subdivision_scheme")
def conversion_record(spark, sf_dir):
    return mesh.conversion_record(spark, 4, "fill", scale=2.0, fill=7.5)


@query("""WITH p AS (SELECT o_custkey % 20 AS g, o_orderkey::DOUBLE AS x, -o_totalprice AS y, CASE WHEN o_orderkey % 9 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS z FROM orders)
    SELECT g, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM p WHERE NOT isnan(z) GROUP BY g""")
def bounds_of_points(spark, sf_dir):
    k = F.col("o_orderkey")
    z = F.when(k % 9 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    points = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 20).alias("g"), k.cast("double").alias("x"), (-F.col("o_totalprice")).alias("y"), z.alias("z"))
    return points.groupBy("g").agg(bounds.expand(F.col("x"), F.col("y"), F.col("z")).alias("b")).select("g", "b.*")


@query("""WITH b AS (SELECT o_custkey % 20 AS g, o_orderkey::DOUBLE AS lo, o_orderkey::DOUBLE + (o_orderkey % 5 - 1)::DOUBLE AS hi FROM orders)
    SELECT g, min(lo) AS min_x, max(hi) AS max_x, min(lo) + (max(hi) - min(lo)) * 0.5::DOUBLE AS center_x, max(hi) - min(lo) AS size_x FROM b WHERE lo <= hi GROUP BY g""")
def bounds_of_bounds(spark, sf_dir):
    k = F.col("o_orderkey").cast("double")
    b = bounds.bounds(k, 0.0, 0.0, k + (F.col("o_orderkey") % 5 - 1), 1.0, 1.0)
    joined = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy((F.col("o_custkey") % 20).alias("g")).agg(bounds.union(b).alias("b"))
    return joined.select("g", F.col("b.min_x"), F.col("b.max_x"), bounds.center(F.col("b"), "x").alias("center_x"), bounds.size(F.col("b"), "x").alias("size_x"))


# Segments and byte ranges -----------------------------------------------------------------


@query("""WITH s AS (SELECT (r * 7 + c)::BIGINT AS segment, (c * 16)::BIGINT AS x0, (r * 16)::BIGINT AS y0, least(16, 100 - c * 16)::BIGINT AS w, least(16, 90 - r * 16)::BIGINT AS h FROM (SELECT unnest(range(0, 7)) AS c), (SELECT unnest(range(0, 6)) AS r))
    SELECT p::INT AS plane, s.* FROM s, (SELECT unnest(range(1, 3)) AS p)""")
def segment_plan(spark, sf_dir):
    return segments.layout(spark, 100, 90, 16, 16, planes=2)


@query(f"""WITH {WIN}, s AS (SELECT (r * 7 + c)::BIGINT AS segment, c * 16 AS x0, r * 16 AS y0, least(16, 100 - c * 16) AS sw, least(16, 90 - r * 16) AS sh FROM (SELECT unnest(range(0, 7)) AS c), (SELECT unnest(range(0, 6)) AS r))
    SELECT event_id, segment, greatest(x, x0)::BIGINT AS x, greatest(y, y0)::BIGINT AS y, (least(x + w, x0 + sw) - greatest(x, x0))::BIGINT AS width, (least(y + h, y0 + sh) - greatest(y, y0))::BIGINT AS height
    FROM win JOIN s ON x < x0 + sw AND x0 < x + w AND y < y0 + sh AND y0 < y + h WHERE w > 0 AND h > 0""")
def window_segment_overlap(spark, sf_dir):
    # Windows lie within the raster, as a read would have checked.
    met = segments.overlapping(segments.layout(spark, 100, 90, 16, 16), _some_windows(spark, sf_dir), 16, 16)
    return met.select("event_id", "segment", "overlap.*")


def _byte_ranges(spark, sf_dir):
    e = F.col("event_id")
    return rasters.events(spark, sf_dir).select((F.col("user_id") % 10).alias("raster_id"), (e * 37 % 5000).alias("offset"), (e % 23).alias("length"))


@query("""WITH b AS (SELECT DISTINCT user_id % 10 AS raster_id, unnest(range(event_id * 37 % 5000, event_id * 37 % 5000 + event_id % 23)) AS byte FROM events)
    SELECT g.raster_id, count(b.byte)::BIGINT AS distinct_bytes FROM (SELECT DISTINCT user_id % 10 AS raster_id FROM events) g LEFT JOIN b USING (raster_id) GROUP BY 1""")
def distinct_bytes(spark, sf_dir):
    return ranges.distinct_bytes(_byte_ranges(spark, sf_dir))


@query("""WITH r AS (SELECT user_id % 10 AS raster_id, event_id * 37 % 5000 AS o, event_id % 23 AS n FROM events WHERE event_id % 50 = 0),
    p AS (SELECT event_id, user_id % 10 AS raster_id, event_id * 11 % 5000 AS b, event_id * 11 % 5000 + event_id % 4 AS e FROM events)
    SELECT event_id, EXISTS (SELECT 1 FROM r WHERE r.raster_id = p.raster_id AND n > 0 AND b < e AND o < e AND b < o + n) AS touched FROM p""")
def range_touched(spark, sf_dir):
    e = F.col("event_id")
    read = rasters.events(spark, sf_dir).filter(e % 50 == 0).select((F.col("user_id") % 10).alias("raster_id"), (e * 37 % 5000).alias("offset"), (e % 23).alias("length"))
    probes = rasters.events(spark, sf_dir).select("event_id", (F.col("user_id") % 10).alias("raster_id"), (e * 11 % 5000).alias("begin"), (e * 11 % 5000 + e % 4).alias("end"))
    return ranges.touched(probes, read).select("event_id", "touched")


@query("""WITH r AS (SELECT user_id % 10 AS raster_id, event_id * 37 % 5000 AS o, event_id % 23 AS n FROM events),
    p AS (SELECT event_id, user_id % 10 AS raster_id, event_id * 11 % 5000 AS b, event_id * 11 % 5000 + event_id % 4 AS e FROM events)
    SELECT event_id, EXISTS (SELECT 1 FROM r WHERE r.raster_id = p.raster_id AND n > 0 AND b < e AND o < e AND b < o + n) AS touched FROM p""")
def range_touched_all(spark, sf_dir):
    """As ``range_touched``, but against the ranges of all events."""
    e = F.col("event_id")
    probes = rasters.events(spark, sf_dir).select("event_id", (F.col("user_id") % 10).alias("raster_id"), (e * 11 % 5000).alias("begin"), (e * 11 % 5000 + e % 4).alias("end"))
    return ranges.touched(probes, _byte_ranges(spark, sf_dir)).select("event_id", "touched")


@query("""SELECT user_id % 10 AS raster_id, sum(event_id % 7)::BIGINT AS requested_bytes, sum(event_id % 64)::BIGINT AS fetched_bytes, count(*) AS request_count,
    coalesce(sum(event_id % 64)::DOUBLE / nullif(sum(event_id % 7), 0)::DOUBLE, 0.0::DOUBLE) AS amplification FROM events GROUP BY 1""")
def read_amplification(spark, sf_dir):
    e = F.col("event_id")
    reads = rasters.events(spark, sf_dir).select((F.col("user_id") % 10).alias("raster_id"), (e % 7).alias("requested_bytes"), (e % 64).alias("fetched_bytes"), F.lit(1).cast("long").alias("request_count"))
    return ranges.read_statistics(reads)


@query("""WITH RECURSIVE s AS (SELECT event_id // 100 AS raster_id, event_id % 100 AS k, 8 + (event_id % 100) * 1000 + CASE WHEN event_id % 100 >= 50 THEN 7 ELSE 0 END AS o FROM events),
    n AS (SELECT raster_id, max(k) AS top FROM s GROUP BY 1),
    f(raster_id, k, start, bytes, cnt) AS (
        SELECT raster_id, 0::BIGINT, 8::BIGINT, 1000::BIGINT, 1::BIGINT FROM n
        UNION ALL
        SELECT f.raster_id, f.k + 1, CASE WHEN f.start + f.bytes = s.o AND f.bytes + 1000 <= 20000 THEN f.start ELSE s.o END,
            CASE WHEN f.start + f.bytes = s.o AND f.bytes + 1000 <= 20000 THEN f.bytes + 1000 ELSE 1000 END, CASE WHEN f.start + f.bytes = s.o AND f.bytes + 1000 <= 20000 THEN f.cnt + 1 ELSE 1 END
        FROM f JOIN s ON s.raster_id = f.raster_id AND s.k = f.k + 1)
    SELECT raster_id, start AS byte_offset, max(bytes) AS byte_count, max(cnt) AS segments FROM f GROUP BY 1, 2""")
def coalesce_batches(spark, sf_dir):
    e = F.col("event_id")
    parts = rasters.events(spark, sf_dir).select(windows.div(e, F.lit(100)).alias("raster_id"), (e % 100).alias("ordinal"), (8 + (e % 100) * 1000 + F.when(e % 100 >= 50, 7).otherwise(0)).alias("byte_offset"), F.lit(1000).cast("long").alias("byte_count"))
    return ranges.coalesced(parts, most=20_000)


# Tiles ---------------------------------------------------------------------------------------


@query(f"""WITH {DEM}, t AS (SELECT i, j, unnest(CASE WHEN i % 32 = 0 AND i > 0 AND i // 32 <= 98 // 32 THEN [i // 32, i // 32 - 1] ELSE [least(i // 32, 98 // 32)] END) AS tx FROM dem),
    u AS (SELECT i, j, tx, unnest(CASE WHEN j % 32 = 0 AND j > 0 AND j // 32 <= greatest(h - 2, 0) // 32 THEN [j // 32, j // 32 - 1] ELSE [least(j // 32, greatest(h - 2, 0) // 32)] END) AS ty FROM t, size)
    SELECT 0::INT AS level, tx AS tile_x, ty AS tile_y, min(i) AS x0, min(j) AS y0, max(i) - min(i) + 1 AS w, max(j) - min(j) + 1 AS h, count(*) AS vertex_count,
        'L0_X' || tx || '_Y' || ty AS tile_name, 'tiles/L0/' || tx || '_' || ty || '.usdc' AS payload_path FROM u GROUP BY tx, ty""")
def shared_edge_tiles(spark, sf_dir):
    samples = rasters.dem_samples(spark, sf_dir).select("c", "r").withColumn("level", F.lit(0))
    return tiling.manifest(tiling.shared_edges(samples, 32, WIDTH, rasters.dem_height(spark, sf_dir)), 32)


@query(f"""WITH {DEM}, l AS (SELECT unnest(range(0, 4)) AS level)
    SELECT level::INT AS level, (i // (1 << level))::BIGINT AS c, (j // (1 << level))::BIGINT AS r, value FROM dem, l WHERE i % (1 << level) = 0 AND j % (1 << level) = 0""")
def pyramid_levels(spark, sf_dir):
    return tiling.pyramid(rasters.dem_samples(spark, sf_dir).select("c", "r", "value"), 4)


@query(f"""WITH {DEM}, l AS (SELECT unnest(range(0, 3)) AS level), p AS (SELECT level, i // (1 << level) AS c, j // (1 << level) AS r FROM dem, l WHERE i % (1 << level) = 0 AND j % (1 << level) = 0)
    SELECT level::INT AS level, (c // 16)::BIGINT AS tile_x, (r // 16)::BIGINT AS tile_y, min(c)::BIGINT AS x0, min(r)::BIGINT AS y0, (max(c) - min(c) + 1)::BIGINT AS w, (max(r) - min(r) + 1)::BIGINT AS h, count(*) AS vertex_count,
        'L' || level || '_X' || (c // 16) || '_Y' || (r // 16) AS tile_name, 'tiles/L' || level || '/' || (c // 16) || '_' || (r // 16) || '.usdc' AS payload_path FROM p GROUP BY level, c // 16, r // 16""")
def tile_manifest(spark, sf_dir):
    levels = tiling.pyramid(rasters.dem_samples(spark, sf_dir).select("c", "r"), 3)
    tiled = levels.withColumns({"tile_x": windows.div(F.col("c"), F.lit(16)), "tile_y": windows.div(F.col("r"), F.lit(16))})
    return tiling.manifest(tiled, 16)


@query(f"""WITH {PLACED} SELECT * FROM (SELECT 0::INT AS corner, x0 AS x, y0 AS y, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM box UNION ALL SELECT 1, x1, y0, 1.0, 0.0 FROM box
    UNION ALL SELECT 2, x1, y1, 1.0, 1.0 FROM box UNION ALL SELECT 3, x0, y1, 0.0, 1.0 FROM box)""")
def image_footprint(spark, sf_dir):
    return tiling.footprint(spark, rasters.flat_bounds(rasters.dem_height(spark, sf_dir)))


# Metadata, diagnostics, keys ---------------------------------------------------------------------


def _rasters(spark, sf_dir):
    """A raster for each supplier: two bands, some with scales, descriptions and NoData."""
    k = F.col("s_suppkey")
    text = lambda c: F.when(c, F.concat(F.lit("band of "), k.cast("string")))
    band = lambda n, kind, scale, description: F.struct(
        F.lit(n).alias("index"), F.lit(kind).alias("data_type"), F.when(k % 2 == 0, F.lit(NODATA)).alias("nodata"), scale.alias("scale"),
        F.when(k % 4 == 0, F.lit(1.5)).alias("offset"), description.alias("description"), F.lit("").alias("unit"))
    bands = F.array(band(1, "uint16", F.lit(0.5), text(k % 3 == 0)), band(2, "float32", F.when(k % 5 != 0, F.lit(2.0)), text(F.lit(False))))
    crs = F.struct(
        F.lit("projected").alias("kind"), F.when(k % 3 != 1, F.lit(32654)).alias("epsg"), F.when(k % 3 == 1, F.lit("LOCAL_CS")).otherwise(F.lit("")).alias("wkt"),
        F.lit("").alias("citation"), F.when(k % 2 == 0, F.lit("metre")).otherwise(F.lit("unknown")).alias("linear_unit"), F.lit(0.0).alias("linear_unit_metres"),
        F.lit("unknown").alias("angular_unit"), F.lit(None).cast("int").alias("vertical_epsg"), F.when(k % 7 == 0, F.lit("foot")).otherwise(F.lit("unknown")).alias("vertical_unit"), F.lit("").alias("vertical_citation"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.cast("string").alias("raster_id"), F.concat(F.lit("s"), k.cast("string"), F.lit(".tif")).alias("source_label"), F.lit(100).cast("long").alias("width"), k.cast("long").alias("height"),
        F.lit(2).alias("band_count"), bands.alias("bands"), rasters.gt().alias("gt"), F.lit(True).alias("has_gt"), F.lit(ANCHOR).alias("pixel_anchor"), F.lit("file").alias("pixel_anchor_source"), crs.alias("crs"),
        F.when(k % 2 == 1, F.struct(F.lit(16).cast("long").alias("width"), F.lit(16).cast("long").alias("height"))).alias("native_tile"),
        F.array().cast("array<struct<width:bigint,height:bigint>>").alias("overviews"), affine.window_bounds(rasters.gt(), F.lit(ANCHOR), windows.window(0, 0, 100, k)).alias("bounds"),
    )


@query("""SELECT s_suppkey::VARCHAR AS raster_id, CASE WHEN s_suppkey % 3 <> 1 THEN 'EPSG:32654' ELSE 'LOCAL_CS' END AS crs, CASE WHEN s_suppkey % 3 = 1 THEN 'LOCAL_CS' END AS crs_wkt,
    CASE WHEN s_suppkey % 2 = 0 THEN 'metre' END AS linear_unit, CASE WHEN s_suppkey % 7 = 0 THEN 'foot' END AS vertical_unit, 2::INT AS band_count,
    CASE WHEN s_suppkey % 5 <> 0 THEN '0.5,2.0' END AS scales, CASE WHEN s_suppkey % 4 = 0 THEN '1.5,1.5' END AS offsets, CASE WHEN s_suppkey % 2 = 0 THEN '-9999.0,-9999.0' END AS nodatas,
    CASE WHEN s_suppkey % 3 = 0 THEN 'band of ' || s_suppkey || ',' END AS descriptions, NULL::VARCHAR AS units, 'float32' AS data_type, CASE WHEN s_suppkey % 2 = 1 THEN 16 END::BIGINT AS tile_width FROM supplier""")
def band_metadata_arrays(spark, sf_dir):
    row = metadata.metadata_row(_rasters(spark, sf_dir), band=2)
    # array_join leaves a null array null.
    listed = lambda n: F.array_join(F.transform(f"`raster:{n}`", lambda v: v.cast("string")), ",")
    return row.select(
        "raster_id", F.col("`geo:crs`").alias("crs"), F.col("`geo:crsWkt`").alias("crs_wkt"), F.col("`geo:linearUnit`").alias("linear_unit"), F.col("`geo:verticalUnit`").alias("vertical_unit"),
        F.col("`raster:bandCount`").alias("band_count"), listed("bandScales").alias("scales"), listed("bandOffsets").alias("offsets"), listed("bandNoDataValues").alias("nodatas"),
        listed("bandDescriptions").alias("descriptions"), listed("bandUnits").alias("units"), F.col("`raster:dataType`").alias("data_type"), F.col("`raster:nativeTileWidth`").alias("tile_width"),
    )


@query("""SELECT s_suppkey::VARCHAR AS raster_id, false AS empty, s_suppkey % 2 = 0 AS metric, s_suppkey % 2 = 0 AND s_suppkey % 7 = 0 AS mixed,
    CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS metres FROM supplier""")
def crs_properties(spark, sf_dir):
    crs = F.col("crs")
    return _rasters(spark, sf_dir).select(
        "raster_id", types.crs_is_empty(crs).alias("empty"), types.crs_is_metric(crs).alias("metric"), types.crs_has_mixed_units(crs).alias("mixed"), types.metres_per_unit(crs["linear_unit"]).alias("metres")
    )


@query("""SELECT (user_id % 10)::VARCHAR AS raster_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS warnings FROM events GROUP BY 1""")
def diagnostic_counts(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "click", "Warning").otherwise("Info")
    return diagnostics.counts(rasters.events(spark, sf_dir).select((F.col("user_id") % 10).cast("string").alias("raster_id"), severity.alias("severity")))


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey::VARCHAR AS cache_key, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 3 END AS identity FROM orders),
    i AS (SELECT c_custkey::VARCHAR AS cache_key, c_custkey % 2 AS identity, c_custkey % 5 <> 0 AS valid FROM customer WHERE c_custkey % 4 <> 0)
    SELECT r.k, CASE WHEN r.identity IS NULL THEN 'IdentityUnavailable' WHEN i.cache_key IS NULL THEN 'Miss' WHEN NOT i.valid THEN 'Corrupt' WHEN r.identity <> i.identity THEN 'StaleIdentity' ELSE 'Hit' END AS state
    FROM r LEFT JOIN i ON r.cache_key = i.cache_key""")
def cache_lookup_state(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").select(o.alias("k"), F.col("o_custkey").cast("string").alias("cache_key"), F.when(o % 11 != 0, F.col("o_custkey") % 3).alias("identity"))
    index = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(c % 4 != 0).select(c.cast("string").alias("cache_key"), (c % 2).alias("identity"), (c % 5 != 0).alias("valid"))
    return cache.lookup(requests, index).select("k", "state")


def _lane_sql(parts: str, start: int, factor: int) -> str:
    """The lane of a digest over a list of bytes: 128-bit products, cut to 64 bits."""
    return f"list_reduce(list_concat([{start}::UHUGEINT], ({parts})::UHUGEINT[]), lambda a, b: (xor(a, b) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _number_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN [110] ELSE list_concat([117], list_transform(range(0, 8), lambda k: (({v})::BIGINT >> (8 * k)::INT) & 255)) END"


_KEY_SQL = f"list_concat(list_concat({_number_sql('event_id % 4 + 1')}, {_number_sql('CASE WHEN event_id % 3 <> 0 THEN event_id % 3 END')}), list_concat({_number_sql('event_id % 16')}, [115, 7, 0, 0, 0, 0, 0, 0, 0, 102, 108, 111, 97, 116, 51, 50]))"
_TILE_SQL = f"list_concat(list_concat({_number_sql('event_id % 3')}, {_number_sql('event_id % 100')}), {_number_sql('event_id % 7')})"


@query(f"""WITH d AS (SELECT event_id, {_lane_sql(_KEY_SQL, cache.HIGH_START, cache.HIGH_FACTOR)} AS high, {_lane_sql(_KEY_SQL, cache.LOW_START, cache.LOW_FACTOR)} AS low,
        {_lane_sql(_TILE_SQL, cache.LOW_START, cache.LOW_FACTOR)} AS tile FROM events)
    SELECT event_id, lower(lpad(hex(high::UBIGINT), 16, '0') || lpad(hex(low::UBIGINT), 16, '0')) AS cache_key,
        CASE WHEN tile >= 9223372036854775808::UHUGEINT THEN (tile::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE tile::BIGINT END AS tile_hash FROM d""")
def cache_key_digest(spark, sf_dir):
    """A 128-bit key for each read, and a hash for each tile."""
    e = F.col("event_id")
    reads = rasters.events(spark, sf_dir)
    key = cache.read_key(e % 4 + 1, F.when(e % 3 != 0, e % 3), e % 16, F.lit("float32"))
    return reads.select("event_id", key.alias("cache_key"), cache.tile_hash(e % 3, e % 100, e % 7).alias("tile_hash"))


@query("""SELECT l_orderkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'L1_X' || l_orderkey || '_Y' || l_linenumber ELSE 'L0_X' || l_orderkey || '_Y' || l_linenumber END AS tile_name FROM lineitem""")
def tile_names(spark, sf_dir):
    name = tiling.tile_name(F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0), F.col("l_orderkey"), F.col("l_linenumber"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), name.alias("tile_name"))
