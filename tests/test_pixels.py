"""Colours as aggregates over pixels against the kernels on whole images, and the kernels as SQL functions."""

import numpy as np
import pytest

from touchline.operators import colours, pixels
from touchline.plans import catalogue, crops

SF = "/root/testdata/sf0.001"
SCHEMA = "crop_id bigint, height int, width int, pixels binary, y string"
SHAPES = [(30, 12), (15, 5), (14, 5), (15, 4), (1, 1), (40, 20), (20, 10), (61, 33)]


def images():
    rng = np.random.default_rng(11)
    made = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for h, w in SHAPES for _ in range(2)]
    flat = [np.full((40, 20, 3), shade, np.uint8) for shade in ((20, 200, 20), (0, 0, 0), (255, 255, 255), (200, 30, 30))]
    two = np.zeros((40, 20, 3), np.uint8)
    two[:20], two[20:] = (200, 30, 30), (30, 30, 200)
    return [*made, *flat, two]


@pytest.fixture
def table(spark):
    rows = [(k, *image.shape[:2], image.tobytes(), "a column of its own") for k, image in enumerate(images())]
    rows += [(100, 0, 0, None, None), (101, 2, 2, b"", None), (102, 3, 3, b"cut short", None), (103, None, None, b"abc", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


EMPTY = [100, 101, 102, 103]


def test_torso(table):
    found = {r["crop_id"]: tuple(r)[1:] for r in pixels.torso_colours(table).collect()}
    for k, image in enumerate(images()):
        part = image[: int(len(image) * 0.6)]
        assert found[k] == pytest.approx(tuple(colours.torso(image))) if part.size else found[k] == (None, None, None)
    assert all(found[k] == (None, None, None) for k in EMPTY) and len(found) == len(images()) + 4


def test_jersey(table):
    found = {r["crop_id"]: r["colour"] for r in pixels.jersey_colours(table).collect()}
    for k, image in enumerate(images()):
        want = colours.jersey(image)
        assert found[k] == pytest.approx(want.tolist()) if want.any() else found[k] is None
    assert all(found[k] is None for k in EMPTY) and any(c is None for c in found.values())


@pytest.mark.parametrize("masked", [True, False])
def test_histogram(table, masked):
    found = {}
    for r in pixels.histograms(table, masked=masked).collect():
        found.setdefault(r["crop_id"], np.zeros(768))[r["bin"]] = r["share"]
    for k, image in enumerate(images()):
        assert np.allclose(found.get(k, np.zeros(768)), colours.histogram(image, masked=masked))
    assert not set(found) & set(EMPTY)


def test_overlaps(spark, table):
    shares = pixels.histograms(table)
    pairs = [(0, 1), (0, 0), (0, 16), (5, 100), (0, 1)]
    found = {(r[0], r[1]): r[2] for r in pixels.overlaps(spark.createDataFrame(pairs, "crop_a bigint, crop_b bigint"), shares).collect()}
    vector = [colours.histogram(image) for image in images()]
    assert len(found) == 4 and found[5, 100] == 0
    assert all(found[a, b] == pytest.approx(np.minimum(vector[a], vector[b]).sum()) for a, b in pairs if b < 100)


def test_kernels_as_sql_functions(spark, table):
    pixels.register(spark, mean_shade=lambda image: np.array([image.mean()]))
    table.createOrReplaceTempView("crops_of_test")
    call = "(pixels, height, width)"
    rows = spark.sql(f"select crop_id, dominant_colour{call} d, jersey_colour{call} j, torso_colour{call} t, crop_histogram{call} c, mean_shade{call} m from crops_of_test").collect()
    kernels = (colours.dominant, colours.jersey, colours.torso, colours.histogram, lambda image: np.array([image.mean()]))
    some = images()
    for row in rows:
        for got, kernel in zip(row[1:], kernels, strict=True):
            want = kernel(some[row[0]]) if row[0] < 100 else np.zeros(1)
            assert got == pytest.approx(want.tolist()) if want.any() else got is None


def test_dominant_finds_planted_colours(spark):
    pixels.register(spark)
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(8):
        upper, lower = rng.integers(0, 2, 3) * 150 + 30, rng.integers(0, 2, 3) * 90 + 10
        image = np.zeros((40, 20, 3), np.uint8)
        image[:18], image[18:] = upper, lower
        rows.append((k, 40, 20, image.tobytes(), None))
        h, s, _ = colours.hsv(np.array([upper, lower])).T
        if not ((h >= 35) & (h <= 85) & (s > 50)).any() and (upper != lower).any():
            want[k] = np.concatenate(colours.lab(np.array([upper, lower])))
    found = {r[0]: r[1] for r in spark.createDataFrame(rows, SCHEMA).selectExpr("crop_id", "dominant_colour(pixels, height, width)").collect()}
    assert want and all(np.allclose(found[k], v) for k, v in want.items())


def test_dominant_colours_query(spark):
    images = {r["crop_id"]: np.frombuffer(r["pixels"], np.uint8).reshape(crops.HEIGHT, crops.WIDTH, 3) for r in crops._crops(spark, SF).collect()}
    found = {r["crop_id"]: r["colour"] for r in catalogue.QUERIES["dominant_colours"](spark, SF).collect()}
    assert found.keys() == images.keys()
    assert all(np.allclose(found[k] or np.zeros(6), colours.dominant(image)) for k, image in images.items())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert all(f(none).count() == 0 for f in (pixels.torso_colours, pixels.jersey_colours, pixels.histograms))
