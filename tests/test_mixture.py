"""The colour mixture's starts against plain expectation-maximisation."""

import math
import os

import numpy as np
import pytest

from touchline.operators import mixture, tracks
from touchline.plans import catalogue, motion

SF = os.environ.get("TOUCHLINE_SF", "/root/testdata/sf0.001")
COLOURS = "colour array<double>"


def plain_em(data, model, rounds, tolerance=1e-3, floor=1e-3):
    """The same rounds over one array: the model and likelihood at the end."""
    before = -math.inf
    for _ in range(rounds):
        w, m, v = (np.array(model[k]) for k in ("weights", "means", "variances"))
        logs = np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum(axis=1) + (((data[:, None] - m) ** 2) / v).sum(axis=2))
        top = logs.max(axis=1)
        total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
        now = total.mean()
        if abs(now - before) < tolerance:
            break
        before, p = now, np.exp(logs - total[:, None])
        mass = p.sum(axis=0)
        means = (p.T @ data) / mass[:, None]
        model = {"weights": mass / len(data), "means": means, "variances": np.maximum((p.T @ data**2) / mass[:, None] - means**2, 0) + floor}
    return model, now


def three_groups():
    rng = np.random.default_rng(11)
    return np.concatenate([rng.normal(0, 0.3, (300, 3)), rng.normal(2, 0.2, (200, 3)), rng.normal((2, -2, 5), 0.3, (250, 3))])


def test_every_start_equals_plain_rounds(spark):
    data = three_groups()
    df = spark.createDataFrame([(r.tolist(),) for r in data], COLOURS)
    found = mixture.fits(df, 3, starts=4)
    assert len(found) == 4 and all(m["converged"] for m in found)
    used = df.selectExpr("colour[0] x0", "colour[1] x1", "colour[2] x2")
    begun = mixture._starts(used, 3, 4, 42, data.mean(axis=0).tolist(), data.var(axis=0).tolist(), 1e-3)
    for start, end in zip(begun, found, strict=True):
        model, likelihood = plain_em(data, start, 100)
        assert end["likelihood"] == pytest.approx(likelihood, abs=1e-7)
        for key in ("weights", "means", "variances"):
            assert np.allclose(end[key], model[key], atol=1e-6)
    best = mixture.fit(df, 3, starts=4)
    top = max(found, key=lambda m: m["likelihood"])
    assert sorted(best["weights"]) == sorted(top["weights"]) and best["weights"][0] >= best["weights"][1]


def test_more_starts_are_never_worse(spark):
    df = spark.createDataFrame([(r.tolist(),) for r in three_groups()], COLOURS)
    likelihoods = [m["likelihood"] for m in mixture.fits(df, 3)]
    assert len(likelihoods) == 10 and max(likelihoods) >= likelihoods[0]


def test_starts_ignore_partitions_and_order(spark):
    data = three_groups()
    one = mixture.fits(spark.createDataFrame([(r.tolist(),) for r in data], COLOURS).coalesce(1), 3, starts=3)
    two = mixture.fits(spark.createDataFrame([(r.tolist(),) for r in data[::-1]], COLOURS).repartition(7), 3, starts=3)
    for a, b in zip(one, two, strict=True):
        assert np.allclose(a["means"], b["means"], atol=1e-9) and a["rounds"] == b["rounds"]


def test_degenerate_samples(spark):
    same = spark.createDataFrame([([1.0, 2.0],)] * 120 + [(None,), ([0.0, 0.0],), ([None, 1.0],)], COLOURS)
    model = mixture.fit(same, 2)
    assert np.allclose(model["means"], [[1, 2], [1, 2]]) and sum(model["weights"]) == pytest.approx(1)
    assert mixture.fit(same.limit(0), 2) is None and mixture.fits(same.limit(99), 2) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_colour_gmm_votes_by_the_likeliest_model(spark):
    samples = motion._colours(spark, SF)
    found = {tuple(r) for r in catalogue.QUERIES["colour_gmm"](spark, SF).collect()}
    data = np.array([r[0] for r in samples.select("colour").collect()])
    data = data[(data**2).sum(axis=1) > 0]
    models = mixture.fits(samples, 6)
    best = max(models, key=lambda m: m["likelihood"])
    _, alone = plain_em(data, {k: best[k] for k in ("weights", "means", "variances")}, 1)
    assert best["likelihood"] == pytest.approx(alone, abs=1e-7)
    order = np.argsort(best["weights"])[::-1]
    votes = tracks.colour_votes(samples, *([best[k][i] for i in order] for k in ("means", "variances", "weights")))
    assert found == {tuple(r) for r in votes.select("video_id", "track_id", "team", "confidence").collect()} and len({r[2] for r in found}) >= 2
