"""Byte ranges against brute force."""

import random

from sparkgrid.operators import ranges
from sparkgrid.plans import queries as plans


def test_touched_against_brute_force(spark):
    rng = random.Random(4)
    pick = lambda most: None if rng.random() < 0.03 else rng.randrange(most)
    read = [(pick(3), pick(900), rng.choice([0, 1, 5, 200, None])) for _ in range(60)]
    probes = [(n, pick(4), b, None if b is None else b + rng.randrange(4)) for n in range(400) for b in [pick(1000)]]
    probes += probes[:5]

    def met(k, b, e):
        return None not in (k, b, e) and b < e and any(q == k and o is not None and n and o < e and b < o + n for q, o, n in read)

    frame = spark.createDataFrame(probes, "n long, raster_id long, begin long, end long")
    out = ranges.touched(frame, spark.createDataFrame(read, "raster_id long, offset long, length long"))
    assert out.columns == [*frame.columns, "touched"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((*p, met(*p[1:])) for p in probes), key=repr)
    # No join of probes with ranges: their pairs would grow with the square of a raster's ranges.
    assert "LeftSemi" not in out._jdf.queryExecution().toString()


def test_all_ranges_are_registered():
    assert "% 50 = 0" not in plans.ORACLE_SQL["range_touched_all"]


def test_distinct_bytes_across_blocks(spark):
    rng = random.Random(8)
    read = [(rng.randrange(3), rng.randrange(900), rng.choice([0, 1, 5, 64, 300])) for _ in range(80)]
    read += read[:10] + [(5, 3, 0)]
    out = ranges.distinct_bytes(spark.createDataFrame(read, "raster_id long, offset long, length long"), block=64)
    expected = {k: len({b for q, o, n in read if q == k for b in range(o, o + n)}) for k in {r[0] for r in read}}
    assert {r["raster_id"]: r["distinct_bytes"] for r in out.collect()} == expected


def one_by_one(rows, most):
    """Batches of (offset, count) in order, folded one segment at a time."""
    out = []
    for offset, count in rows:
        if out and out[-1][0] + out[-1][1] == offset and out[-1][1] + count <= most:
            out[-1] = (out[-1][0], out[-1][1] + count, out[-1][2] + 1)
        else:
            out.append((offset, count, 1))
    return out


def test_coalesced_against_a_fold(spark):
    rng = random.Random(6)
    rows, expected = [], []
    for raster in (None, "a", "b", "c"):
        at, own = 0, []
        for _ in range(300):
            at += rng.choice([0, 0, 0, 7])
            own.append((at, rng.choice([1, 10, 40, 100, 130])))
            at += own[-1][1]
        rows += [(raster, k, *s) for k, s in enumerate(own)]
        expected += [(raster, *b) for b in one_by_one(own, 100)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "raster_id string, ordinal long, byte_offset long, byte_count long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # batches end inside of runs
    try:
        assert sorted(map(tuple, ranges.coalesced(frame, most=100).collect()), key=repr) == sorted(expected, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ranges.coalesced(frame.limit(0)).count() == 0


def test_one_long_run_takes_linear_time():
    import numpy as np

    n = 1_000_000
    sizes = np.full(n, 512)
    starts = ranges.batch_starts(np.cumsum(sizes) - sizes, sizes, 64 << 10)
    assert len(starts) == -(-n // 128) and set(np.diff(starts)) == {128}
