import math

import numpy as np
import pytest

from sparkgrid.diagnostics import Code, RasterError, Sink
from sparkgrid.operators.grid import Window
from sparkgrid.sources import tiff as reader
from sparkgrid.sources.bytesource import MemorySource, RecordingSource, Status, exactly
from sparkgrid.sources.tiff import Container, Options, Plan, plan, read_window
from tests.tiffs import ramp, tiff

QUAD = np.array([[10, 20], [30, 40]])
WIDE = Options(output_type="float64")


def metadata(data: bytes, sink: Sink | None = None):
    return Container(MemorySource(data), sink).metadata


def window(data: bytes, *box: int, **options):
    source = RecordingSource(MemorySource(data))
    return read_window(source, Window(*box), Options(**{"output_type": "float64", **options}))


def code_of(data: bytes) -> Code:
    with pytest.raises(RasterError) as error:
        metadata(data)
    return error.value.diagnostic.code


@pytest.mark.parametrize("how", [{}, {"order": ">"}, {"big": True}, {"big": True, "order": ">"}])
def test_containers(how):
    m = metadata(tiff(QUAD.astype("f4"), **how))
    assert (m.width, m.height, m.anchor, m.crs["epsg"], m.crs["linear_unit"]) == (2, 2, "area", 32654, "metre")
    assert m.gt == (300000.0, 2.0, 0.0, 4400000.0, 0.0, -2.0)
    values, _, _ = window(tiff(QUAD.astype("f4"), **how), 0, 0, 2, 2)
    assert values.tolist() == QUAD.tolist()


def test_metadata_reads_no_pixels():
    data = tiff(ramp(8, 8), rows=2)
    source = RecordingSource(MemorySource(data))
    layout = Container(source).layout
    assert not any(source.touched(o, o + n) for o, n in layout.segments)


def test_georeferencing():
    cos, sin = math.cos(math.pi / 6) * 2, math.sin(math.pi / 6) * 2
    turned = metadata(tiff(QUAD.astype("f4"), scale=None, matrix=[cos, sin, 0, 1.0, sin, -cos, 0, 2.0, 0, 0, 0, 0, 0, 0, 0, 1]))
    assert turned.gt[2] != 0 and turned.gt[4] != 0
    sink = Sink()
    both = metadata(tiff(QUAD.astype("f4"), matrix=[5.0, 0, 0, 1000.0, 0, -5.0, 0, 2000.0, 0, 0, 0, 0, 0, 0, 0, 1]), sink)
    assert both.gt == (1000.0, 5.0, 0.0, 2000.0, 0.0, -5.0)
    assert [d.code for d in sink.found] == [Code.ConflictingGeoTransform]
    none = metadata(tiff(QUAD.astype("f4"), geo=False))
    assert none.gt is None and none.crs["epsg"] is None and none.bounds() is None
    sink = Sink()
    assert metadata(tiff(QUAD.astype("f4"), anchor=None), sink).bounds() is None
    assert [d.code for d in sink.found] == [Code.UnknownPixelAnchor]
    assert metadata(tiff(QUAD.astype("f4"), anchor=2)).anchor == "point"
    assert metadata(tiff(QUAD.astype("f8"), model=2, epsg=4326, scale=0.25, tie=(139.0, 36.0))).crs["kind"] == "geographic"


def test_bounds():
    m = metadata(tiff(QUAD.astype("f4")))
    assert m.bounds() == (300000.0, 4399996.0, 0.0, 300004.0, 4400000.0, 0.0)
    m.anchor = "point"
    assert m.bounds() == (300000.0, 4399998.0, 0.0, 300002.0, 4400000.0, 0.0)


def test_nodata_and_band_metadata():
    assert metadata(tiff(QUAD.astype("f4"), nodata="-9999 ")).bands[0]["nodata"] == -9999
    assert math.isnan(metadata(tiff(QUAD.astype("f4"), nodata="nan")).bands[0]["nodata"])
    for text in ("abc", "inf", "1e400", "", "1x", "1e-400"):
        assert code_of(tiff(QUAD.astype("f4"), nodata=text)) is Code.InvalidNoDataValue
    xml = '<G><Item name="SCALE" sample="0"> .5 </Item><Item name="offset" sample="0">100</Item><Item name="unittype" sample="0">metre</Item><Item name="description" sample="0">Elevation &amp; height</Item><Item name="scale">9</Item></G>'
    band = metadata(tiff(QUAD.astype("u2"), gdal=xml)).bands[0]
    assert (band["scale"], band["offset"], band["unit"], band["description"]) == (0.5, 100.0, "metre", "Elevation & height")
    values, _, _ = window(tiff(QUAD.astype("u2"), gdal=xml), 0, 0, 2, 2)
    assert values.ravel().tolist() == [105, 110, 115, 120]
    assert reader.unescape("&amp;lt;") == "<"


def test_missing_samples():
    data = tiff(np.array([[10, -9999], [30, 40]], "f4"), nodata="-9999")
    assert window(data, 0, 0, 2, 2)[1].tolist() == [[False, True], [False, False]]
    data = tiff(np.array([[10, math.nan], [30, 40]], "f4"), nodata="nan")
    assert window(data, 0, 0, 2, 2)[1].sum() == 1
    xml = '<Item name="scale" sample="0">2</Item>'
    data = tiff(np.array([[10, 20], [30, 40]], "f4"), nodata="20", gdal=xml)
    assert window(data, 0, 0, 2, 2)[1].tolist() == [[True, False], [False, False]]
    assert window(data, 0, 0, 2, 2, nodata_stage="raw")[1].tolist() == [[False, True], [False, False]]


def test_strip_window_figures():
    values, _, stats = window(tiff(ramp(8, 8), rows=2), 2, 1, 3, 3)
    assert values.ravel().tolist() == [10, 11, 12, 18, 19, 20, 26, 27, 28]
    assert stats == {"requested_bytes": 18, "fetched_bytes": 64, "request_count": 1, "amplification": 64 / 18}


def test_tiles():
    data = tiff(ramp(32, 32), tile=(16, 16))
    values, _, stats = window(data, 2, 3, 4, 4)
    assert (values[0, 0], values[-1, -1], stats["fetched_bytes"], stats["request_count"]) == (98, 197, 512, 1)
    part = tiff(ramp(20, 20), tile=(16, 16))
    values, _, stats = window(part, 16, 16, 4, 4)
    assert (values[0, 0], values[-1, -1], stats["fetched_bytes"]) == (336, 399, 512)
    container = Container(MemorySource(data))
    w = reader.tile_window(container, 1, 1)
    values, _, _ = read_window(MemorySource(data), w, WIDE)
    assert (values[0, 0], values[-1, -1]) == (528, 1023)
    with pytest.raises(RasterError):
        reader.tile_window(container, 2, 0)


def test_decimation_and_overviews():
    values, _, _ = window(tiff(ramp(8, 8), rows=2), 1, 1, 5, 5, step=2)
    assert values.ravel().tolist() == [9, 11, 13, 25, 27, 29, 41, 43, 45]
    data = tiff(ramp(8, 8), overviews=[(1000 + np.arange(16)).reshape(4, 4).astype("u2")])
    values, _, stats = window(data, 0, 0, 8, 8, step=2)
    assert values.ravel().tolist() == list(range(1000, 1016)) and stats["fetched_bytes"] == 32
    values, _, _ = window(data, 0, 0, 8, 8, level=0)
    assert values.shape == (4, 4)
    with pytest.raises(RasterError) as error:
        window(data, 0, 0, 8, 8, level=1)
    assert error.value.diagnostic.code is Code.UnsupportedOverviewLevel
    container = Container(MemorySource(data))
    assert reader.tile_window(container, 0, 0, level=0) == Window(0, 0, 8, 8)


def test_budget():
    data = tiff(ramp(8, 8), rows=2)
    assert window(data, 2, 1, 3, 3, budget=136)[0][0, 0] == 10
    with pytest.raises(RasterError) as error:
        window(data, 2, 1, 3, 3, budget=135)
    assert error.value.diagnostic.code is Code.MemoryBudgetExceeded
    with pytest.raises(RasterError):
        window(tiff(ramp(8, 8), compression=8), 2, 1, 3, 3, budget=200)


@pytest.mark.parametrize("dtype", ["u1", "i1", "u2", "i2", "u4", "i4", "f4", "f8"])
@pytest.mark.parametrize("order", ["<", ">"])
def test_sample_types(dtype, order):
    if dtype[0] == "f":
        data = np.array([[0.5, -1.25], [3e30, 4]], dtype)
    else:
        low, high = np.iinfo(dtype).min, np.iinfo(dtype).max
        data = np.array([[low, low + 1], [high - 1, high]], dtype)
    assert window(tiff(data, order=order), 0, 0, 2, 2)[0].tolist() == data.astype("f8").tolist()


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("how", [{"rows": 3}, {"tile": (16, 16)}, {"rows": 8, "order": ">"}])
def test_codecs(compression, predictor, how):
    data = tiff(ramp(8, 8), compression=compression, predictor=predictor, **how)
    assert window(data, 2, 1, 3, 3)[0].ravel().tolist() == [10, 11, 12, 18, 19, 20, 26, 27, 28]


@pytest.mark.parametrize("dtype", ["f4", "f8"])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("planar", [1, 2])
def test_floating_predictor(dtype, order, planar):
    both = np.stack([QUAD, QUAD + 100], axis=2).astype(dtype)
    values, _, _ = window(tiff(both, predictor=3, order=order, planar=planar), 0, 0, 2, 2, band=2)
    assert values.ravel().tolist() == [110, 120, 130, 140]


def test_bands():
    both = np.stack([QUAD, QUAD + 100], axis=2).astype("u2")
    values, _, stats = window(tiff(both, planar=2, rows=1), 0, 0, 2, 2, band=2)
    assert values.ravel().tolist() == [110, 120, 130, 140] and stats["fetched_bytes"] == 8
    assert window(tiff(both, predictor=2), 0, 0, 2, 2, band=2)[0].ravel().tolist() == [110, 120, 130, 140]
    with pytest.raises(RasterError) as error:
        window(tiff(both), 0, 0, 2, 2, band=3)
    assert error.value.diagnostic.code is Code.InvalidBandIndex


def test_large_lzw_codes():
    from sparkgrid.sources.codecs import unpack_lzw

    data = bytes(np.random.default_rng(1).integers(0, 4, 40_000).astype(np.uint8))
    assert unpack_lzw(_lzw(data), len(data)) == data


def _lzw(data: bytes) -> bytes:
    bits: list[int] = []

    def emit(code, n):
        bits.extend(code >> (n - 1 - k) & 1 for k in range(n))

    words, width, w = {bytes([k]): k for k in range(256)}, 9, b""
    emit(256, 9)
    count = 258
    for b in data:
        c = w + bytes([b])
        if c in words:
            w = c
            continue
        emit(words[w], width)
        words[c] = count
        count += 1
        if count == 4094:
            emit(256, width)
            words, width, count = {bytes([k]): k for k in range(256)}, 9, 258
        elif count >= 1 << width:
            width += 1
        w = bytes([b])
    emit(words[w], width)
    emit(257, width)
    return np.packbits(np.array(bits, np.uint8)).tobytes()


@pytest.mark.parametrize(
    ("data", "code"),
    [
        (b"II*", Code.TruncatedHeader),
        (b"XX*\0\x08\0\0\0", Code.InvalidSignature),
        (b"II\x07\0\x08\0\0\0", Code.UnsupportedVersion),
        (b"II*\0\0\0\0\0", Code.InvalidOffset),
        (tiff(QUAD.astype("u2"), drop=(256,)), Code.InvalidRasterSize),
        (tiff(QUAD.astype("u2"), drop=(258,)), Code.UnsupportedSampleFormat),
        (tiff(QUAD.astype("u2"), drop=(273,)), Code.InconsistentTileLayout),
        (tiff(QUAD.astype("u2"), drop=(33922,)), Code.InvalidGeoTransform),
        (tiff(QUAD.astype("u2"), extra=[(259, "H", [7])]), Code.UnsupportedCompression),
        (tiff(QUAD.astype("u2"), extra=[(284, "H", [3])]), Code.UnsupportedPlanarConfiguration),
        (tiff(QUAD.astype("u2"), extra=[(317, "H", [9])]), Code.UnsupportedSampleFormat),
        (tiff(QUAD.astype("u2"), extra=[(317, "H", [3])]), Code.UnsupportedSampleFormat),
        (tiff(QUAD.astype("u2"), extra=[(34735, "H", [1, 1, 0])]), Code.InvalidCrs),
        (tiff(QUAD.astype("u2"), extra=[(273, "I", [9999])]), Code.InvalidOffset),
    ],
)
def test_faults(data, code):
    assert code_of(data) is code


def test_missing_rows_per_strip_is_one_strip():
    assert window(tiff(QUAD.astype("u2"), drop=(278,)), 0, 0, 2, 2)[0].ravel().tolist() == [10, 20, 30, 40]


def test_window_faults_and_warnings():
    with pytest.raises(RasterError) as error:
        window(tiff(ramp(8, 8)), 6, 6, 3, 3)
    assert error.value.diagnostic.code is Code.WindowOutOfBounds and error.value.diagnostic.window == (6, 6, 3, 3)
    assert window(tiff(ramp(8, 8)), 3, 3, 0, 2)[0].shape == (2, 0)
    sink = Sink()
    read_window(MemorySource(tiff(QUAD.astype("f8"))), Window(0, 0, 2, 2), Options(), sink)
    assert [d.code for d in sink.found if d.code is Code.LossyConversion]


def test_batches_end_at_their_limit():
    data = tiff(ramp(256, 512), rows=32)
    p: Plan = plan(Container(MemorySource(data)), Window(0, 0, 256, 512), WIDE)
    assert [p.batch_range(b)[1] for b in p.batches] == [65536] * 4


def test_byte_sources():
    source = MemorySource(b"abcdef")
    assert source.read(6, 0) == (Status.ok, b"")
    assert source.read(7, 0)[0] is Status.end_of_source
    assert source.read(4, 5) == (Status.short_read, b"ef")
    recording = RecordingSource(source)
    for o, n in ((0, 3), (2, 3), (1, 1), (5, 1)):
        recording.read(o, n)
    assert recording.distinct_bytes() == 6
    assert recording.touched(5, 6) and not recording.touched(6, 9)
    with pytest.raises(RasterError) as error:
        exactly(source, 4, 5)
    assert error.value.diagnostic.code is Code.TruncatedData


def test_cancelling():
    source = RecordingSource(MemorySource(tiff(ramp(8, 8), rows=2)))
    polls = iter([False, False, True])
    with pytest.raises(RasterError) as error:
        read_window(source, Window(0, 0, 8, 8), Options(output_type="float64", cancelled=lambda: next(polls)))
    assert error.value.diagnostic.code is Code.Cancelled
    layout = Container(MemorySource(tiff(ramp(8, 8), rows=2))).layout
    assert sum(source_range == (layout.segments[0][0], 128) for source_range in source.ranges) == 1
