"""Registered queries against their SQL, on the smallest test tables."""

import math
import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in sorted(entry.oracle_sql()) if not re.match(r"op\d|pipeline", n)]


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(want.columns) == sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["blk15_lossless_roundtrip", "src9_info", "src11_exif_read", "snk2_serializers", "snk12_api_buffers", "flt5_container_validity", "met1_parse_block"])
def test_whole_table(spark, tmp_path, name):
    """Ids past any prefix and past 16 bits, and a partial image."""
    import duckdb

    rows = [(i, i * 7, float(i % 500)) for i in (*range(9 * 256, 9 * 256 + 40), 70_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    assert got and got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
