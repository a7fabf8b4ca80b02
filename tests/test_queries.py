"""Every query against its SQL, as the driver compares them, at the smallest scale."""

import math
import os

import duckdb
import pytest

from sparkgrid.plans import files
from sparkgrid.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def same_rows(frame, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in frame.collect()), key=repr)
    assert got == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(plans.ORACLE_SQL))
def test_query(spark, duck, name):
    same_rows(plans.QUERIES[name](spark, SF), duck, plans.ORACLE_SQL[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(files.ORACLE_SQL))
def test_files(spark, duck, name):
    same_rows(files.QUERIES[name](spark, SF), duck, files.ORACLE_SQL[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
