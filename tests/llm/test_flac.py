import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.llm import flac
from sparkgrid.scratch import stored


def payloads():
    rng = random.Random(1)
    return [b"", b"a", b"the quick brown fox " * 300, bytes(range(256)) * 9, bytes(5000), b"\xff" * 3000, rng.randbytes(2500), bytes(rng.choice(b"ab") for _ in range(1025))]


def pcm_bytes(blocks):
    return (np.concatenate([b for _, b in blocks]).view(np.uint8) ^ 0x80).tobytes()


@pytest.mark.parametrize("how", [{}, {"coefficients": (1,)}, {"coefficients": (2, -1)}, {"coefficients": (29, -14, 3), "shift": 4}])
def test_round_trip(how):
    data = [flac.payload(p) for p in payloads()]
    for p, blocks in zip(data, flac.decode(flac.encode(data, **how)), strict=True):
        assert pcm_bytes(blocks) == p
        assert [f for f, _ in blocks] == list(range(0, len(p), flac.BLOCK))


def test_palette():
    data = [flac.payload(p) for p in payloads()]
    coded = [flac.ranked(p) for p in data]
    streams = flac.encode([c for c, _ in coded], palettes=[p for _, p in coded])
    assert [pcm_bytes(b) for b in flac.decode(streams)] == data
    bare = []
    for s, (_, p) in zip(streams, coded, strict=True):
        end = 42 + 4 + 4 + len(p)  # stream info, then the palette
        table = int.from_bytes(s[end + 1 : end + 4], "big")
        bare.append(s[:42] + b"\x82" + s[43:end] + s[end + 4 + table :])
    assert [pcm_bytes(b) for b in flac.decode(bare)] == data
    assert flac.ranked(b"abcbcc") == (bytes([129, 127, 128, 127, 128, 128]), b"cba")
    text = flac.payload(b"Rice codes are short where samples are small, and letters are not. " * 90)
    c, p = flac.ranked(text)
    assert len(flac.encode([c], palettes=[p])[0]) < 0.65 * len(flac.encode([text])[0])


def test_compresses_and_seeks():
    smooth = bytes(int(128 + 60 * np.sin(k / 40)) for k in range(20_000))
    (stream,) = flac.encode([smooth])
    assert len(stream) < 0.5 * len(smooth)
    frames, firsts, _, total = flac.split_stream(stream)
    at = firsts.index(5 * flac.BLOCK)
    (block,) = flac.decode_frames([frames[at]])
    assert (block.view(np.uint8) ^ 0x80).tobytes() == smooth[5 * flac.BLOCK : 6 * flac.BLOCK] and total == 20_000


@pytest.mark.parametrize("block", [192, 1000, 2048])
def test_blocks_of_other_sizes(block, monkeypatch):
    data = [flac.payload(p) for p in payloads()]
    streams = flac.encode(data, block=block)
    for p, blocks in zip(data, flac.decode(streams), strict=True):
        assert pcm_bytes(blocks) == p
        assert [f for f, _ in blocks] == list(range(0, len(p), block))
    monkeypatch.setattr(flac, "FRAMES", 3)
    assert flac.encode(data, block=block) == streams


def without_seek_table(stream):
    at = stream.index(b"\x83", 40)
    size = int.from_bytes(stream[at + 1 : at + 4], "big")
    return stream[:4] + b"\x80" + stream[5:at] + stream[at + 4 + size :]


def test_stream_without_seek_table():
    data = [flac.payload(p) for p in payloads()]
    bare = [without_seek_table(s) for s in flac.encode(data)]
    assert [pcm_bytes(b) for b in flac.decode(bare)] == data


def test_damage_is_noticed():
    (stream,) = flac.encode([flac.payload(b"some bytes to be damaged " * 90)])
    for at in (len(stream) - 1, len(stream) - 700, 30):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])


def bit_string(*fields):
    bits = "".join(format(v & (1 << n) - 1, f"0{n}b") if n else "" for v, n in fields)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def frame(size, *fields):
    body = flac.frame_header(0, size) + bit_string(*fields)
    return body + flac.crc16([body]).astype(">u2").tobytes()


def rice(v, k):
    z = v << 1 if v >= 0 else -2 * v - 1
    return [(0, z >> k), (1, 1), (z & (1 << k) - 1, k)]


def test_hand_made_subframes():
    constant = frame(64, (0, 8), (-5, 8))
    assert flac.decode_frames([constant])[0].tolist() == [-5] * 64
    # Two Rice partitions, the second escaped to raw numbers of 5 bits.
    res = [3, -2, 0, 7] * 16
    coded = [f for v in res[1:32] for f in rice(v, 2)]
    raw = [(v, 5) for v in res[32:]]
    mixed = frame(64, (0x12, 8), (1, 8), (0, 2), (1, 4), (2, 4), *coded, (15, 4), (5, 5), *raw)
    assert flac.decode_frames([mixed])[0].tolist() == np.cumsum([1, *res[1:]]).astype(np.int8).tolist()
    # A fixed predictor of order 4 with residuals of 0 continues a cubic; 5-bit parameters.
    cubic = [k**3 // 64 for k in range(4)]
    fourth = frame(16, (0x18, 8), *[(v, 8) for v in (0, 1, 2, 3)], (1, 2), (0, 4), (0, 5), *[f for _ in range(12) for f in rice(0, 0)])
    assert flac.decode_frames([fourth])[0].tolist() == list(range(16)) and cubic[0] == 0
    # A long run of zeros in a unary code.
    long = frame(64, (0x10, 8), (0, 2), (0, 4), (0, 4), *rice(-60, 0), *[f for _ in range(63) for f in rice(0, 0)])
    assert flac.decode_frames([long])[0].tolist() == [-60] + [0] * 63


def test_coded_numbers():
    assert [flac.coded_number(n).hex() for n in (0, 127, 128, 2047, 2048, 65535, 65536)] == ["00", "7f", "c280", "dfbf", "e0a080", "efbfbf", "f0908080"]
    big = flac.frame_header(70_000, flac.BLOCK)
    assert flac._parse_header(big.ljust(16, b"\0")) == (len(big), flac.BLOCK)


def naive_features(payload):
    """The feature string, sample by sample."""
    x = [b - 128 for b in payload]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"n={len(x)};sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings};range={min(x)}..{max(x)}"


def test_linear_predictors_are_fitted():
    rng = np.random.default_rng(3)
    x, y = [0.0, 0.0], []
    for _ in range(4096):  # a resonance that differences do not follow
        x.append(1.2 * x[-1] - 0.9 * x[-2] + rng.normal(0, 2))
        y.append(int(np.clip(round(x[-1]), -128, 127)) + 128)
    data = bytes(y)
    alone = flac.encode([data])
    frames, *_ = flac.split_stream(alone[0])
    kinds = [f[flac._parse_header(f[:16])[0]] >> 1 for f in frames]
    assert all(k == 32 + flac.ORDER - 1 for k in kinds)
    assert pcm_bytes(flac.decode(alone)[0]) == data and len(alone[0]) < 0.6 * len(data)
    # A stream does not depend on what is coded beside it.
    assert flac.encode([b"other " * 700, data, bytes(64)])[1] == alone[0]


def test_documents(spark, documents, odd_rows):
    docs = documents(odd_rows).withColumns({"media": F.lit("m"), "n_bytes": F.lit("n"), "pcm": F.lit("p")})
    media = stored(flac.store(docs), "media")
    kept = stored(flac.pcm_blocks(media), "blocks")
    rows = flac.summaries(kept).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, flac.summaries(flac.keep(docs)).collect()))
    assert len(rows) == len(odd_rows)
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in rows)
    by_text = {}
    for r in rows:
        texts = [t for i, t, *_ in odd_rows if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]]
        p = flac.payload((texts[0] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["feature"] == naive_features(p)
        assert by_text.setdefault(p, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    long = flac.payload(next(t for i, t, *_ in odd_rows if i == 7).encode())
    found = kept.filter("doc_id = 7").withColumn("part", flac.samples_at(F.lit(5_000), F.lit(3_000))).filter("part IS NOT NULL").orderBy("first_sample").collect()
    assert [r["first_sample"] for r in found] == list(range(4 * 1024, 8_000, 1024))
    assert bytes(b ^ 0x80 for r in found for b in r["part"]) == long[5_000:8_000]
    blocks = kept.groupBy("doc_id").agg(F.sum("n_samples").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in blocks}[7] == next(r["payload_bytes"] for r in rows if r["doc_id"] == 7)
    assert flac.summaries(flac.keep(docs.limit(0))).count() == 0
