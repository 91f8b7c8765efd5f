"""Every registered query of the tracking engine against its DuckDB twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from touchline.plans import catalogue

SF = os.environ.get("TOUCHLINE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
SLOW = {"colour_gmm", "streaming_tracker", "projection_stream", "ball_stream", "ball_tracker", "homography_ransac", "dominance_averaged"}  # tests/test_mixture.py has the first, tests/test_passes.py the last four

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return round(float(value), 9) if isinstance(value, (bool, int, float)) or hasattr(value, "dtype") else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_its_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_runs_without_sql(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    assert found.columns and found.count() > 0


def test_stream_equals_batch(spark):
    one = catalogue.QUERIES["streaming_tracker"](spark, SF)
    two = catalogue.QUERIES["iou_tracker"](spark, SF)
    assert rows(one.columns, [tuple(r) for r in one.collect()]) == rows(two.columns, [tuple(r) for r in two.collect()])


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
