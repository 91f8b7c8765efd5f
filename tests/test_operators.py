"""Hand-made cases: ties, bounds, empty inputs, single rows."""

import itertools
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.functions import geometry as G
from touchline.functions import pitch
from touchline.operators import annotations, colours, datasets, detections, filters, fragments, influence, mixture, tracking, tracks, trajectories
from touchline.sources import readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_projection_bounds(spark):
    h = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    assert one(spark, *G.project(h, F.lit(3.0), F.lit(4.0))) == (3.0, 4.0)
    flat = [h[0], h[1], [F.lit(0.0)] * 3]
    assert one(spark, *G.project(flat, F.lit(3.0), F.lit(4.0))) == (None, None)
    assert one(spark, *G.on_pitch(F.lit(60.0), F.lit(-78.0))) == (57.5, -39.0)
    assert one(spark, *G.on_pitch(F.lit(116.0), F.lit(0.0))) == (None, None)


def test_inverse_times_matrix_is_one(spark):
    m = [[F.lit(float(v)) for v in row] for row in ((2, 1, 0), (0, 3, 1), (1, 0, 4))]
    got = one(spark, *(c for row in G.product(m, G.inverse(m)) for c in row))
    assert got == pytest.approx((1, 0, 0, 0, 1, 0, 0, 0, 1))
    singular = [[F.lit(1.0)] * 3] * 3
    assert one(spark, G.inverse(singular)[0][0]) == (None,)


def test_box_formats(spark):
    box = [F.lit(v) for v in (10.0, 20.0, 4.0, 6.0)]
    assert one(spark, *G.convert_box(*box, "cxcywh")) == (8.0, 17.0, 12.0, 23.0)
    with pytest.raises(ValueError):
        G.convert_box(*box, "other")


def test_colour_bounds(spark):
    cases = {(14, 99, 99): 3, (15, 99, 99): 0, (40, 99, 99): 0, (41, 99, 99): 6, (100, 99, 99): 4, (30, 99, 99): 5, (0, 49, 181): 1, (0, 49, 59): 2, (0, 49, 60): 0}
    for hsv, want in cases.items():
        assert one(spark, G.colour_class(*(F.lit(v) for v in hsv))) == (want,)


def test_template_and_vocabulary():
    assert len(pitch.template()) == 23 and len(pitch.LINE_CLASSES) == 28
    assert {line for line, *_ in pitch.template()} <= set(pitch.LINE_CLASSES)


def test_confidence_bounds(spark):
    df = spark.createDataFrame([(0.3,), (0.31,)], "score double")
    assert filters.confident(df, 0.3, True).count() == 1 and filters.confident(df, 0.3, False).count() == 2


def test_sampling_never_divides_by_zero(spark):
    df = spark.range(10).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_idx"))
    assert filters.sample_frames(df, 10.0, 30.0).count() == 10
    assert [r[1] for r in filters.sample_frames(df, 30.0, 10.0, start=1, end=8, most=2).orderBy("frame_idx").collect()] == [1, 4]


def test_stats_leave_out_unprojected_tracks(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0, 2.0), (1, 2, 0, None, None)], "video_id bigint, track_id bigint, frame_idx bigint, pitch_x double, pitch_y double")
    got = tracks.position_stats(df).collect()
    assert len(got) == 1 and got[0]["std_x"] == 0 and got[0]["n_samples"] == 1
    assert tracks.position_stats(df.limit(0)).count() == 0


def test_outliers_need_both_neighbours(spark):
    xs = [0.0, 0.1, 50.0, 0.3, 0.4, 90.0]
    df = spark.createDataFrame([(1, 1, k, x, 0.0) for k, x in enumerate(xs)], "video_id bigint, track_id bigint, frame_idx bigint, pitch_x double, pitch_y double")
    flags = [r["is_outlier"] for r in trajectories.outliers(df).orderBy("frame_idx").collect()]
    assert flags == [False, False, True, False, False, False]


def test_asof_reaches_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trajectories, "BLOCK_FRAMES", 4)
    obs = spark.createDataFrame([(1, f) for f in range(0, 20)] + [(2, 3)], "video_id bigint, frame_idx bigint")
    hom = spark.createDataFrame([(1, 2, 2.0), (1, 3, 3.0), (1, 17, 17.0), (2, 9, 9.0)], "video_id bigint, frame_idx bigint, h00 double")
    got = {(r[0], r[1]): r["h00"] for r in trajectories.asof_homography(obs, hom).collect()}
    want = {(1, f): None if f < 2 else 2.0 if f < 3 else 3.0 if f < 17 else 17.0 for f in range(20)} | {(2, 3): None}
    assert got == want


def test_single_point_tracks(spark):
    df = spark.createDataFrame([(1, 1, 5, 1.0, 2.0)], "video_id bigint, track_id bigint, frame_idx bigint, pitch_x double, pitch_y double")
    dense = trajectories.fill_gaps(df)
    assert [tuple(r) for r in dense.collect()] == [(1, 1, 5, 1.0, 2.0)]
    assert trajectories.gaussian_smooth(dense).first()["x"] == pytest.approx(1.0)
    assert trajectories.velocities(dense).first()["vx"] == 0.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-30, 30)), min_size=1, max_size=60))
def test_speed_limit_holds(points):
    p = np.array(points)
    out = trajectories.limit_speed(p, np.arange(len(p)), 0.4)
    assert (np.linalg.norm(np.diff(out, axis=0), axis=1) <= 0.4 + 1e-9).all() and (out[0] == p[0]).all()
    flat = trajectories.smooth(np.full((len(p), 2), 3.0), 7.0)
    assert np.allclose(flat, 3.0)


def test_assignment_is_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, m = (int(v) for v in rng.integers(1, 6, 2))
        cost = rng.random((n, m)).round(1)
        k, pairs = min(n, m), tracking.assign(cost)
        best = min(sum(cost[r, c] for r, c in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert len(pairs) == k and sum(cost[r, c] for r, c in pairs) == pytest.approx(best)


def test_tracker_repeats_and_forgets():
    t = tracking.BoxTracker(max_age=2)
    box = np.array([[0.0, 0, 10, 10]])
    assert t.step(0, box) == [(0, 1, 0, [0.0, 0.0, 10.0, 10.0])]
    assert t.step(2, box)[0][:3] == (1, 1, -1)
    copy = tracking.BoxTracker.loads(t.dumps())
    assert copy.step(3, box) == t.step(3, box)
    assert t.step(10, box)[-1][1] == 2


def test_ball_falls_on_when_hidden():
    t = tracking.BallTracker(max_age=1)
    for k in range(5):
        state = t.step([(10.0 * k, 0.0, 0.9)])
    assert state[5] and state[6] == 1 and state[2] > 0
    for _ in range(2):
        state = t.step([])
    assert state[6] == -1 and not state[5] and state[4] == 0.3


def test_homography_survives_outliers_and_mirrors():
    rng = np.random.default_rng(2)
    src = rng.random((20, 2)) * (1900, 1000)
    dst = (src - (960, 540)) / (15, -10)
    bad = dst.copy()
    bad[:5] += 200
    h, n, mirrored = tracking.estimate(src, bad)
    assert n == 15 and not mirrored and h[0, 0] == pytest.approx(1 / 15)
    assert tracking.estimate(src[:3], dst[:3]) is None


def test_fragment_bounds(spark):
    schema = "video_id bigint, track_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double"
    box = lambda f, t, x: (1, t, f, x, 0.0, x + 10, 20.0)
    obs = spark.createDataFrame([box(0, 1, 0.0), box(30, 2, 150.0), box(61, 3, 150.0), box(61, 4, 301.0)], schema)
    pairs = {(r["parent"], r["child"]) for r in fragments.parents(fragments.summaries(obs)).collect()}
    assert pairs == {(1, 2)}


def test_crowded_fragments_find_the_best_parent(spark):
    """Against all pairs; minima are hashed, as sorts of all pairs spilled, and pairs that are far apart are never made."""
    rng = np.random.default_rng(4)
    made = [(v, t, int(f), float(x), float(y), float(x) + 10, float(y) + float(h)) for v in (1, 2) for t, f, x, y, h in zip(range(300), rng.integers(0, 90, 300), rng.integers(0, 60, 300) * 10, rng.integers(0, 30, 300) * 10, rng.integers(20, 40, 300))]
    rows = fragments.summaries(spark.createDataFrame(made, "video_id bigint, track_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double"))
    known, best = {(r["video_id"], r["track_id"]): r for r in rows.collect()}, {}
    for (v, child), c in known.items():
        for (w, parent), p in known.items():
            gap, apart = c["first_frame"] - p["last_frame"], np.hypot(c["head"]["cx"] - p["tail"]["cx"], c["head"]["cy"] - p["tail"]["cy"])
            tall = max(c["head"]["h"], p["tail"]["h"]) / max(min(c["head"]["h"], p["tail"]["h"]), 1)
            if v == w and p["track_ordinal"] < c["track_ordinal"] and 0 <= gap <= 30 and apart <= 150 and tall <= 1.5:
                best.setdefault((v, child), []).append((gap + 0.5 * apart + 50 * (tall - 1), p["track_ordinal"], parent))
    found = fragments.parents(rows)
    assert {(r["video_id"], r["child"]): r["parent"] for r in found.collect()} == {k: min(v)[2] for k, v in best.items()}
    assert {(r["video_id"], r["child"], r["parent"]) for r in fragments.candidates(rows).collect()} == {(*k, p[2]) for k, v in best.items() for p in v}
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_frame_pairs_meet_in_cells_once(spark):
    rng = np.random.default_rng(5)
    made = [(1, t, f, float(x), float(y), float(x) + w, float(y) + h) for f in range(3) for t, x, y, w, h in zip(range(60), rng.integers(-100, 300, 60), rng.integers(-100, 300, 60), map(float, rng.integers(-5, 150, 60)), map(float, rng.integers(-5, 150, 60)))]
    obs = spark.createDataFrame(made, "video_id bigint, track_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double")
    want = sorted((a[2], a[1], b[1]) for a in made for b in made if b[2] == a[2] + 1 and min(a[5], b[5]) > max(a[3], b[3]) and min(a[6], b[6]) > max(a[4], b[4]))
    found = fragments.frame_pairs(obs)
    assert sorted((r["frame_idx"], r["track_a"], r["track_b"]) for r in found.collect()) == want and "_cx" in found._jdf.queryExecution().toString()


def test_components_follow_long_chains(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    nodes = spark.range(1, 40).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("track_id"))
    links = nodes.filter("track_id > 1 and track_id <> 20").select("video_id", F.col("track_id").alias("child"), (F.col("track_id") - 1).alias("parent"))
    got = {r["track_id"]: r["root"] for r in fragments.components(nodes, links).collect()}
    assert got == {k: 1 if k < 20 else 20 for k in range(1, 40)}


def test_merge_keeps_first_source(spark):
    df = spark.createDataFrame([(1, "train", "a", "x"), (0, "val", "a", "y"), (0, "train", "a", "z"), (0, "train", "a", "w"), (2, "val", "b", "x")], "dataset int, split string, image string, class_name string")
    got = sorted(tuple(r) for r in datasets.merge(df).select("image", "dataset", "split", "class_name").collect())
    assert got == [("a", 0, "train", "w"), ("a", 0, "train", "z"), ("b", 2, "val", "x")]


def test_uncertainty_defaults(spark):
    df = spark.createDataFrame([("a", []), ("b", [None, 0.5]), ("c", None)], "path string, boxes array<double>")
    assert {r["path"]: r["uncertainty"] for r in datasets.uncertainty(df).collect()} == {"a": 1.0, "b": 0.5, "c": 1.0}


def test_mixture_finds_two_colours(spark):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(1, 0.1, (150, 2)), rng.normal(3, 0.2, (100, 2))])
    df = spark.createDataFrame([([float(v) for v in r],) for r in data], "colour array<double>")
    model = mixture.fit(df, 2)
    assert model["weights"] == pytest.approx([0.6, 0.4], abs=0.01) and model["means"][0] == pytest.approx([1, 1], abs=0.05)
    assert mixture.fit(df.limit(50), 2) is None


def test_dominance_shares_sum_to_one(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 1.0, 0.0), (1, 0, 1, 20.0, 0.0, 0.0, 0.0)], "video_id bigint, frame_idx bigint, team int, x double, y double, vx double, vy double")
    got = influence.dominance(influence.influence(df)).selectExpr("max(share_0 + share_1)", "max(share_0)", "count(*)").first()
    assert got[0] <= 1 and got[1] > 0.9 and got[2] == 21 * 13


def test_readers(spark, tmp_path):
    mot = tmp_path / "mot" / "seq1" / "gt"
    mot.mkdir(parents=True)
    (mot / "gt.txt").write_text("1,7,10,20,5,6,1,1,0.5,-1\n2,7,11,21,5,6,1,1,0.5,-1\n")
    assert readers.read_mot(spark, str(tmp_path / "mot")).select("seq_name", "frame", "x").collect()[0][0] == "seq1"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(mot / "gt.txt", "train/seq1/gt/gt.txt")
        z.writestr("train/seq2/readme", "no truth")
    spark.dataSource.register(readers.ZipSequences)
    assert [tuple(r)[:3] for r in spark.read.format("zip_mot").load(str(tmp_path / "a.zip")).orderBy("frame").collect()] == [("seq1", 1, 7), ("seq1", 2, 7)]
    cal = tmp_path / "cal"
    cal.mkdir()
    (cal / "f1.json").write_text('{"Goal left post left ": [{"x": 0.1, "y": 0.2}], "Middle line": []}')
    (cal / "f2.json").write_text("{}")
    assert [tuple(r) for r in readers.read_calibration(spark, str(cal)).collect()] == [("f1", "Goal left post left ", 0, 0.1, 0.2)]
    yolo = tmp_path / "yolo" / "train"
    yolo.mkdir(parents=True)
    (yolo / "img.txt").write_text("1 0.5 0.5 0.1 0.2\n\n2 0.5\n")
    assert [tuple(r) for r in readers.read_yolo(spark, str(tmp_path / "yolo")).collect()] == [("train", "img", 1, 0.5, 0.5, 0.1, 0.2)]
    info = tmp_path / "sets" / "one"
    info.mkdir(parents=True)
    (info / "dataset_info.json").write_text('{"name": "one",\n "class_distribution": {"a": 1}}')
    assert readers.read_datasets(spark, str(tmp_path / "sets")).first()["class_distribution"] == {"a": 1}


def test_xml_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(3, 7, "a<b", 1, 1.0, 2.0, 3.5, 4.0)], "frame_key bigint, track_id bigint, label string, occluded int, x1 double, y1 double, x2 double, y2 double")
    xml = annotations.image_xml(boxes).first()["xml"]
    (tmp_path / "a.xml").write_text(f"<annotations>{xml}</annotations>")
    got = readers.read_images_xml(spark, str(tmp_path / "a.xml")).first()
    assert (got["frame_idx"], got["label"], got["xbr"], got["occluded"], got["attributes"]) == (3, "a<b", 3.5, True, {"track_id": "7"})


def test_colour_spaces():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [0, 0, 0]]], dtype=np.uint8)
    assert colours.hsv(rgb)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0]]
    assert np.allclose(colours.lab(rgb)[0, 3], [255, 128, 128], atol=0.5) and np.allclose(colours.lab(rgb)[0, 4], [0, 128, 128], atol=0.5)


def test_crop_features(spark):
    crop = np.zeros((40, 20, 3), np.uint8)
    crop[:20], crop[20:] = (200, 30, 30), (30, 30, 200)
    upper, lower = np.split(colours.dominant(crop), 2)
    assert np.allclose(upper, colours.lab(crop[0, 0])) and np.allclose(lower, colours.lab(crop[-1, 0]))
    assert np.allclose(colours.jersey(crop)[:3], colours.lab(crop[0, 0]))
    assert not colours.jersey(crop[:10]).any() and not colours.dominant(crop[:10]).any()
    assert np.linalg.norm(colours.histogram(crop)) == pytest.approx(1) and len(colours.histogram(crop)) == 768
    grass = np.full((40, 20, 3), (20, 200, 20), np.uint8)
    rows = [(1, 40, 20, crop.tobytes()), (2, 40, 20, grass.tobytes()), (3, 0, 0, None)]
    got = {r[0]: r[1] for r in colours.features(spark.createDataFrame(rows, "crop_id bigint, height int, width int, pixels binary"), colours.dominant).collect()}
    assert got[1] and got[2] is None and got[3] is None


def test_suppression_keeps_the_best(spark):
    rows = [(1, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 0.8, 1.0, 1.0, 11.0, 11.0), (1, 0, 3, 0.7, 50.0, 0.0, 60.0, 10.0), (1, 1, 4, 0.1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, det_id bigint, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["det_id"] for r in detections.suppress(df, 0.45).collect()) == [1, 3, 4]


def test_command_line(capsys):
    from touchline import cli

    assert cli.main(["list"]) == 0 and "role_summary" in capsys.readouterr().out
