"""The passes over a match: as streams and batches, against plain Python."""

import os
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import datasets, filters, influence, projection, tracking, trajectories
from touchline.plans import catalogue, motion
from touchline.plans import projection as plan
from touchline.sources.fixtures import observations
from touchline.streaming import matches

SF = os.environ.get("TOUCHLINE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df, *columns):
    plain = lambda v: "~" if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)


PLACES = ["video_id", "frame_idx", "track", "det_id", "x1", "y2", "pitch_x", "pitch_y", "placed_by"]


@pytest.mark.parametrize("run", [7, 45, 10_000])
def test_projection_stream_equals_batch(spark, run):
    dets, tries = motion._detections(spark, SF), plan._tries(spark, SF)
    batch = projection.project_tracks(tracking.track_boxes(dets), tries, track="track")
    stream = matches.run_in_order(matches.match_rows(dets, tries), matches.project_stream, motion._scratch(spark), run)
    assert rows(stream, *PLACES) == rows(batch, *PLACES)
    assert {r[0] for r in batch.select("placed_by").distinct().collect()} == {"homography", "calibration", None}


def test_calibration_of_blocks_equals_one_block(spark, monkeypatch):
    tries = plan._tries(spark, SF)
    want = rows(projection.project_tracks(observations(spark, SF), tries), "event_id", "pitch_x", "pitch_y", "placed_by")
    monkeypatch.setattr(trajectories, "BLOCK_FRAMES", 13)
    assert rows(projection.project_tracks(observations(spark, SF), tries), "event_id", "pitch_x", "pitch_y", "placed_by") == want


def test_tries_hold_and_fail(spark):
    box = {"video_id": 1, "track_id": 3, "x1": 0.0, "y1": 0.0, "x2": 20.0, "y2": 5.0}
    tracks = spark.createDataFrame([{**box, "frame_idx": f} for f in range(6)])
    one = dict.fromkeys(tracking.ENTRIES, 0.0) | {"h00": 1.0, "h11": 1.0, "h22": 1.0}
    made = [{**one, "video_id": 1, "frame_idx": 1}, {**dict.fromkeys(tracking.ENTRIES, 0.0), "video_id": 1, "frame_idx": 2}, {**one, "h02": 200.0, "video_id": 1, "frame_idx": 4}]
    tries = spark.createDataFrame(made)
    found = {r["frame_idx"]: (r["pitch_x"], r["pitch_y"], r["placed_by"]) for r in projection.project_tracks(tracks, tries).collect()}
    nowhere = (None, None, None)
    assert found == {0: nowhere, 1: (10.0, 5.0, "homography"), 2: nowhere, 3: nowhere, 4: nowhere, 5: nowhere}
    assert {r["frame_idx"]: r["placed_by"] for r in projection.project_tracks(tracks, tries, interval=3).collect()} == dict.fromkeys(range(6))
    assert projection.project_tracks(tracks.limit(0), tries).count() == 0


def test_reset_starts_ids_anew(spark):
    boxes = [(1, f, 10 * f + k, 100.0 * k, 0.0, 100.0 * k + 50, 50.0) for f in range(6) for k in range(2)]
    dets = spark.createDataFrame(boxes, "video_id long, frame_idx long, det_id long, x1 double, y1 double, x2 double, y2 double")
    resets = spark.createDataFrame([(1, 3)], "video_id long, frame_idx long")
    found = matches.run_in_order(matches.match_rows(dets.withColumn("x1", F.col("x1") + F.when(F.col("frame_idx") > 2, 20).otherwise(0)), resets=resets), matches.project_stream, motion._scratch(spark), 2)
    assert {(r["frame_idx"], r["track"]) for r in found.collect()} == {(f, t) for f in range(6) for t in (1, 2)}
    fresh = matches.run_in_order(matches.match_rows(dets), matches.project_stream, motion._scratch(spark), 2)
    assert {r["track"] for r in fresh.collect()} == {1, 2}
    balls = spark.createDataFrame([(1, f, f, 0.9, 10.0 * f, 0.0, 10.0 * f + 20, 20.0) for f in range(8)], "video_id long, frame_idx long, ball_id long, score double, x1 double, y1 double, x2 double, y2 double")
    players = dets.withColumn("player_no", F.col("det_id")).filter("false")
    made = matches.run_in_order(matches.ball_rows(balls, players, resets.withColumn("frame_idx", F.lit(4).cast("long"))), matches.ball_stream, motion._scratch(spark), 3)
    assert [r["frame_idx"] for r in made.orderBy("frame_idx").collect()] == [2, 3, 6, 7] and {r["track"] for r in made.collect()} == {1}


def test_reset_keeps_the_balls_velocity():
    t = tracking.BallTracker()
    for k in range(5):
        t.step([(10.0 * k, 0.0, 0.9)])
    speed = t.velocity.copy()
    t.reset()
    assert (t.velocity == speed).all() and speed[0] > 0 and t.next_id == 1 and not t.tracks and not t.path
    b = tracking.BoxTracker(max_age=5)
    b.step(0, np.array([[0.0, 0, 1, 1]]))
    b.reset()
    assert b.max_age == 5 and b.step(1, np.array([[0.0, 0, 1, 1]]))[0][1] == 1


def _plain_ball(spark):
    """The ball's pass in plain loops over whole frames."""
    obs = observations(spark, SF).toPandas()
    out = []
    for video, match in obs.groupby("video_id"):
        tracker, frames = tracking.BallTracker(), dict(list(match.groupby("frame_idx")))
        for f in range(match.frame_idx.min(), match.frame_idx.max() + 1):
            points = []
            if f in frames:
                for r in frames[f][frames[f].event_id % 3 == 0].itertuples():
                    x, y, w, h = (r.x1 + r.x2) / 2, r.y1 + (r.y2 - r.y1) * ((r.event_id % 10) / 10.0), 10.0 + r.event_id % 50, 10.0 + r.event_id % 30
                    x1, y1, x2, y2 = x - w / 2, y - h / 2, x + w / 2, y + h / 2
                    x, y, w, h = (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1
                    ok = w <= 50 and h <= 50 and 0.5 <= w / max(h, 1) <= 2
                    for p in frames[f][frames[f].event_id % 3 != 0].sort_values("track_id").itertuples():
                        if p.x1 <= x <= p.x2 and p.y1 <= y <= p.y2:
                            ok = ok and (y < p.y1 + (p.y2 - p.y1) * 0.3 or y > p.y1 + (p.y2 - p.y1) * 0.9)
                            break
                    points += [(x, y, r.score)] if ok else []
            if ball := tracker.step(sorted(points)):
                out.append((video, f, *ball))
    return out


BALL = ["video_id", "frame_idx", "x", "y", "vx", "vy", "confidence", "visible", "track"]


def test_ball_equals_plain_loops(spark):
    want = sorted((tuple(str(v) if isinstance(v, (bool, np.bool_)) else round(float(v), 5) + 0.0 for v in r) for r in _plain_ball(spark)), key=str)
    batch = catalogue.QUERIES["ball_tracker"](spark, SF)
    assert rows(batch, *BALL) == want and len(want) > 50
    assert rows(catalogue.QUERIES["ball_stream"](spark, SF), *BALL) == want
    assert batch.filter("track = -1 or not visible").count() > 0


def test_invalid_balls_start_no_track(spark):
    box = "video_id long, frame_idx long, ball_id long, score double, x1 double, y1 double, x2 double, y2 double"
    balls = spark.createDataFrame([(1, f, f, 0.9, 0.0, 0.0, 60.0, 20.0) for f in range(6)], box)
    players = balls.select("video_id", "frame_idx", F.col("ball_id").alias("player_no"), "x1", "y1", "x2", "y2").filter("false")
    assert matches.run_in_order(matches.ball_rows(balls, players), matches.ball_stream, motion._scratch(spark), 3).count() == 0
    valid = filters.valid_balls(balls, players).select("video_id", "frame_idx", F.col("x1").alias("cx"), F.col("y1").alias("cy"), "score")
    assert tracking.track_ball(valid, balls).count() == 0


def test_failed_homographies_hold(spark):
    found = catalogue.QUERIES["homography_ransac"](spark, SF).toPandas()
    fits = tracking.frame_homographies(plan._line_points(spark, SF)).toPandas().sort_values(["video_id", "frame_idx"])
    want = []
    for video, match in fits.groupby("video_id"):
        average, failed = None, 0
        for r in match.itertuples():
            if r.points < 6:
                continue
            h = np.array([getattr(r, n) for n in tracking.ENTRIES])
            failed = failed + 1 if np.isnan(h[0]) else 0
            if not failed:
                average = h if average is None else 0.85 * average + 0.15 * h
            if average is not None and failed <= 15:
                want.append((video, r.frame_idx, failed, *average.round(6)))
    got = [(r.video_id, r.frame_idx, r.held, *np.array([getattr(r, n) for n in tracking.ENTRIES]).round(6)) for r in found.sort_values(["video_id", "frame_idx"]).itertuples()]
    assert got == want and (found.held > 0).any() and (fits.points < 6).any()


def test_homography_holds_for_fifteen_failures():
    state = tracking.AveragedHomography()
    one = np.arange(9.0)
    assert state.step(None) is None and state.step(one)[1] == 0
    assert [state.step(None) is not None for _ in range(16)] == [True] * 15 + [False]
    assert state.step(None, enough=False) is None and state.failed == 16
    assert (state.step(one + 1)[0] == 0.85 * one + 0.15 * (one + 1)).all()


def test_frames_over_batches_and_matches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        few = rows(tracking.track_boxes(motion._detections(spark, SF)), "video_id", "frame_idx", "track", "det_id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert few == rows(tracking.track_boxes(motion._detections(spark, SF)), "video_id", "frame_idx", "track", "det_id")


def test_stream_goes_on_after_a_restart(spark):
    base = f"{motion._scratch(spark)}/restart-{uuid.uuid4().hex}"
    table = matches.match_rows(motion._detections(spark, SF), plan._tries(spark, SF))

    def run(first, last):
        part = table.filter((F.col("frame_idx") >= first) & (F.col("frame_idx") < last))
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{base}/in")
        matches.project_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

    run(0, 30)
    run(30, 10_000)
    batch = projection.project_tracks(tracking.track_boxes(motion._detections(spark, SF)), plan._tries(spark, SF), track="track")
    assert rows(spark.read.parquet(f"{base}/out"), *PLACES) == rows(batch, *PLACES)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_averaged_dominance_equals_plain_loops(spark, chunk):
    rng = np.random.default_rng(9)
    made = [(v, f, int(t), *map(float, rng.normal(0, (20, 15, 3, 3)))) for v in (1, 2) for f in range(0, 40, 1 + v) if f % 7 for t in rng.integers(-1, 2, 5)]
    players = spark.createDataFrame(made, "video_id long, frame_idx long, team int, x double, y double, vx double, vy double")
    size = {"columns": 24, "rows": 17, "scale": 48.0}
    found = influence.averaged_dominance(players, chunk=chunk, **size).toPandas().sort_values(["video_id", "frame_idx"])
    want = []
    for v in (1, 2):
        average = None
        for f in sorted({m[1] for m in made if m[0] == v and m[2] in (0, 1)}):
            cells = np.zeros((2, 17, 24))
            for _, _, team, x, y, vx, vy in (m for m in made if m[:2] == (v, f) and m[2] in (0, 1)):
                for i in range(17):
                    for j in range(24):
                        px, py = (j * 48 - 50) / 10 - 52.5, 34 - (i * 48 - 50) / 10
                        s, a = min(np.hypot(vx, vy), 8), np.arctan2(vy, vx)
                        dx, dy = px - x - 0.5 * vx, py - y - 0.5 * vy
                        along, side = dx * np.cos(a) + dy * np.sin(a), dy * np.cos(a) - dx * np.sin(a)
                        cells[team, i, j] += np.exp(-(along**2 / (2 * (4 + 0.5 * s) ** 2) + side**2 / (2 * (4 / (1 + 0.1 * s)) ** 2)))
            average = cells if average is None else 0.9 * average + 0.1 * cells
            on = np.array([[abs((j * 48 - 50) / 10 - 52.5) <= 52.5 and abs(34 - (i * 48 - 50) / 10) <= 34 for j in range(24)] for i in range(17)])
            share = average / (average.sum(axis=0) + 1e-6)
            want.append((v, f, share[0][on].mean(), share[1][on].mean(), int((average[0] > average[1])[on].sum())))
    assert found[["video_id", "frame_idx", "cells_0"]].to_numpy().tolist() == [[r[0], r[1], r[4]] for r in want]
    assert np.allclose(found[["share_0", "share_1"]].to_numpy(), [r[2:4] for r in want], atol=1e-12) and influence.averaged_dominance(players.limit(0)).count() == 0


def test_levels_equal_exponentials():
    """Many players, some far off the pitch and a team of one: products from column to column must lose nothing."""
    rng = np.random.default_rng(3)
    across, down = influence._grid(287, 195, 4.0, 50.0, 10.0)
    places = rng.normal(0, (25, 16, 5, 5), (700, 4))
    places[:3], places[3] = [(1e4, 0, 9, 0), (-3e3, 2e3, 0, 0), (57, -39, 0, -9)], (-57, 39, 8, 0)
    kind = np.arange(700) % 2
    kind[[2, 3]] = 2, 3
    found = influence._levels(places, kind, 4, across, down)
    for k in range(4):
        want = np.zeros((195, 287))
        for x, y, vx, vy in places[kind == k]:
            s, a = min(np.hypot(vx, vy), 8), np.arctan2(vy, vx)
            dx, dy = across[None, :] - x - vx / 2, down[:, None] - y - vy / 2
            want += np.exp(-0.5 * (((dx * np.cos(a) + dy * np.sin(a)) / (4 + s / 2)) ** 2 + ((dy * np.cos(a) - dx * np.sin(a)) * (1 + s / 10) / 4) ** 2))
        assert np.allclose(found[k], want, rtol=1e-11, atol=1e-300)


def test_dominance_is_dealt_to_more_tasks_than_its_bytes_need(spark):
    """A frame is few bytes and much work: neither may follow AQE's sizes, nor a match be a handful of chunks."""
    made = [(1, f, p % 2, float(p), 0.0, 1.0, 0.0) for f in range(50) for p in range(4)]
    players = spark.createDataFrame(made, "video_id long, frame_idx long, team int, x double, y double, vx double, vy double")
    assert influence.frame_dominance(players, columns=24, rows=17, scale=48.0).select(F.spark_partition_id()).distinct().count() > 4
    averaged = influence.averaged_dominance(players, columns=24, rows=17, scale=48.0)
    assert averaged.count() == 50 and "REPARTITION_BY_NUM" in averaged._jdf.queryExecution().toString()


def test_annotations_are_ranked_within_images(spark):
    """A window over a split had all of its boxes in one task."""
    df = catalogue.QUERIES["yolo_to_coco"](spark, SF)
    specs = re.findall(r"windowspecdefinition\(([^)]*)", df._jdf.queryExecution().optimizedPlan().toString())
    assert any("class_id" in s for s in specs) and all("image#" in s.split("class_id")[0].split(" ASC")[0] for s in specs if "class_id" in s)
    ids = {s: sorted(r["annotation_id"] for r in df.filter(F.col("split") == s).collect()) for s in (0, 1)}
    assert all(v == list(range(1, len(v) + 1)) for v in ids.values())


def test_exact_split_has_its_size(spark):
    paths = spark.range(1003).select(F.concat(F.lit("img_"), "id").alias("path"), F.lit(1).alias("_n"))
    for ratio in (0.0, 0.37, 0.8, 1.0):
        one = {r["path"] for r in datasets.exact_split(paths.repartition(7), ratio).filter("split = 'train'").collect()}
        assert len(one) == int(1003 * ratio) and one == {r["path"] for r in datasets.exact_split(paths.coalesce(1), ratio).filter("split = 'train'").collect()}
    other = {r["path"] for r in datasets.exact_split(paths, 0.37, seed=7).filter("split = 'train'").collect()}
    assert len(other) == 371 and datasets.exact_split(paths.limit(0), 0.5).count() == 0
