"""The ball's pass on crowded frames, against plain loops; each would take the old code a product of points and tracks, or of balls and players."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from touchline.operators import filters, tracking
from touchline.streaming import matches

BOX = ["x1", "y1", "x2", "y2"]


def some(rng, n, span=(300, 200), large=70.0):
    low = rng.random((n, 2)) * span
    rows = np.hstack([low, low + rng.random((n, 2)) * large]).round(0)
    return pd.DataFrame(rows, columns=BOX).assign(video_id=1, frame_idx=2, number=rng.permutation(n), score=rng.random(n))


def plain(balls, players):
    """Numbers of the balls that pass."""
    out = set()
    for b in balls.itertuples():
        x, y, w, h = (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1
        ok = w <= 50 and h <= 50 and 0.5 <= w / max(h, 1) <= 2
        for p in players.sort_values("number").itertuples():
            if p.x1 <= x <= p.x2 and p.y1 <= y <= p.y2:
                ok = ok and (y < p.y1 + (p.y2 - p.y1) * 0.3 or y > p.y1 + (p.y2 - p.y1) * 0.9)
                break
        out |= {b.number} if ok else set()
    return out


def test_points_equal_plain_loops():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 300):
        balls, players = some(rng, n), some(rng, 2 * n)
        passed = balls[balls["number"].isin(plain(balls, players))]
        want = sorted(((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.score) for b in passed.itertuples())
        assert matches.valid_points(balls, players) == want


def test_valid_balls_meet_in_cells(spark):
    rng = np.random.default_rng(7)
    balls = some(rng, 150, (3000, 900)).assign(x1=lambda t: t.x1 - 500, x2=lambda t: t.x2 - 500)
    players = pd.concat([some(rng, 100, (3000, 900), large) for large in (70.0, 2500.0, -70.0)]).assign(number=range(300))
    b = spark.createDataFrame(balls).withColumnRenamed("number", "ball_id")
    p = spark.createDataFrame(players.assign(x1=players.x1 - 500, x2=players.x2 - 500)).withColumn("player_no", F.col("number") * 7 % 300)
    got = filters.valid_balls(b, p)
    want = plain(balls, p.toPandas().assign(number=lambda t: t.player_no))
    assert {r.ball_id for r in got.collect()} == want and 10 < len(want) < 140
    assert sorted(got.columns) == sorted(b.columns) and got.count() == len(want)
    assert "_cx" in got._jdf.queryExecution().toString()


def test_crowded_tracks_step_in_time():
    rng = np.random.default_rng(8)
    tracker = tracking.BallTracker()
    began = time.process_time()
    for _ in range(3):
        tracker.step([tuple(p) for p in (rng.random((2500, 3)) * [1920, 1080, 1]).tolist()])
    assert len(tracker.tracks) > 2500 and time.process_time() - began < 5  # 19 s by loops over all pairs
