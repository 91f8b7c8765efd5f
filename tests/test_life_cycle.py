"""Data sets on disk, roles, calibration sums and the drawn grid against plain Python."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import datasets, detections, influence, tracks, trajectories
from touchline.sources import readers


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_create_and_stamp(spark, tmp_path):
    one = readers.create_dataset(spark, str(tmp_path), "a", "coco", 0.7).first()
    assert (one.name, one.format, one.num_images, one.train_split) == ("a", "coco", 0, 0.7) and one.created_at == one.updated_at
    with pytest.raises(ValueError):
        readers.create_dataset(spark, str(tmp_path), "a")
    readers.create_dataset(spark, str(tmp_path), "b")
    assert [r.name for r in readers.read_datasets(spark, str(tmp_path)).collect()] == ["a", "b"]
    later = readers.stamped(readers.read_datasets(spark, str(tmp_path)), F.lit(3), F.lit(8)).first()
    assert (later.num_images, later.num_annotations) == (3, 8) and later.created_at == one.created_at < later.updated_at


def test_merge_checks_formats(spark):
    known = spark.createDataFrame([("a", "yolo"), ("b", "yolo"), ("c", "coco")], "name string, format string")
    rows = [("a", "val", "1.jpg", "x"), ("b", "train", "1.jpg", "y"), ("b", "train", "2.jpg", "z"), ("c", "train", "3.jpg", "w")]
    labels = spark.createDataFrame(rows, "dataset string, split string, image string, class_name string")
    found = datasets.merge_named(known, labels, ["b", "a"]).select("dataset", "image", "class_name").collect()
    assert sorted(map(tuple, found)) == [("b", "1.jpg", "y"), ("b", "2.jpg", "z")]
    assert datasets.merge_named(known, labels, ["b", "a"], False).count() == 3
    with pytest.raises(ValueError, match="formats"):
        datasets.merge_named(known, labels, ["a", "c"])
    with pytest.raises(ValueError, match="nowhere"):
        datasets.merge_named(known, labels, ["a", "nowhere"])


def test_videos_and_metadata(spark, tmp_path):
    for v in ("m2", "m1"):
        write(tmp_path / v / "metadata.json", {"video_id": v, "fps": 25.0})
    write(tmp_path / "bare" / "other.txt", "x")
    assert [r.video_id for r in readers.list_videos(spark, str(tmp_path)).collect()] == ["m1", "m2"]
    assert readers.load_metadata(spark, str(tmp_path), "m1").first().fps == 25.0
    with pytest.raises(FileNotFoundError):
        readers.load_metadata(spark, str(tmp_path), "m3")


def test_calibration_pairs(spark, tmp_path):
    line = {"Middle line": [{"x": 0.1, "y": 0.2}]}
    for name, content, image in (("1", line, True), ("2", line, False), ("3", {}, True)):
        write(tmp_path / f"{name}.json", content)
        if image:
            write(tmp_path / f"{name}.jpg", "-")
    assert [r.frame_id for r in readers.read_calibration_pairs(spark, str(tmp_path)).collect()] == ["1"]


def test_line_samples(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / "images" / "train" / f"{name}.jpg", "-")
    write(tmp_path / "labels" / "train" / "a.json", {"lines": {"l": [1, 2]}})
    write(tmp_path / "labels" / "train" / "z.json", {"lines": {}})
    (one,) = readers.read_line_samples(spark, str(tmp_path), "train").collect()
    assert one.image.endswith("/train/a.jpg") and json.loads(one.lines) == {"l": [1, 2]} and one.extremities == "{}"
    write(tmp_path / "images" / "c.jpg", "-")
    write(tmp_path / "train_annotations.json", [{"image": "c.jpg", "lines": {"k": []}}, {"image": "gone.jpg", "lines": {}}])
    (two,) = readers.read_line_samples(spark, str(tmp_path), "train").collect()
    assert two.image.endswith("/images/c.jpg") and json.loads(two.lines) == {"k": []}
    assert readers.read_line_samples(spark, str(tmp_path), "val").count() == 0


def test_data_yaml_and_records(spark, tmp_path):
    readers.write_data_yaml(spark, str(tmp_path), {"ball": 1, "player": 0})
    text = [r.value for r in spark.read.text(f"{tmp_path}/data.yaml").collect()]
    assert text == ["names:", "  0: player", "  1: ball", f"path: {tmp_path}", "train: images/train", "val: images/val"]
    det = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0.5, 0, "player", None, [0.1])], "x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, class_name string, track_id bigint, embedding array<double>")
    assert json.loads(detections.records(det).first().record) == {"bbox": [1.0, 2.0, 3.0, 4.0], "confidence": 0.5, "class_id": 0, "class_name": "player", "track_id": None}


def test_roles_of_four_kinds(spark):
    rng, rows, colours = np.random.default_rng(3), [], []
    cast = {1: (-45, 0, 1, 1), 2: (0, -33, 20, 1), 3: (0, 0, 9, 9), 4: (20, 5, 5, 5), 5: (-20, 5, 5, 5), 6: (1, 1, 5, 5), 7: (45, 0, 1, 1)}
    shade = {3: 0.5, 4: 1.0, 5: 0.0, 6: None}
    for t, (x, y, sx, sy) in cast.items():
        for f in range(60 if t != 6 else 20):
            rows.append((0, t, f, float(x + sx * rng.uniform(-1, 1)), float(y + sy * rng.uniform(-1, 1))))
            if shade.get(t) is not None:
                colours.append((0, t, [shade[t]]))
    obs = spark.createDataFrame(rows, "video_id bigint, track_id bigint, frame_idx bigint, pitch_x double, pitch_y double")
    samples = spark.createDataFrame(colours, "video_id bigint, track_id bigint, colour array<double>")
    model = {"means": [[0.0], [1.0]], "variances": [[0.1], [0.1]], "weights": [0.5, 0.5]}
    found = {r.track_id: (r.role, r.team, r.player_id) for r in tracks.assign_roles(obs, samples, model).collect()}
    # team 1 stands on the right, so its goal and goalkeeper are where team 0 has the larger mean: the left keeper is of the team further right
    assert found == {1: ("goalie", 1, 1), 2: ("linesman", -1, None), 3: ("referee", -1, None), 4: ("player", 1, None), 5: ("player", 0, None), 7: ("goalie", 0, 1)}
    bare = {r.track_id: (r.role, r.team) for r in tracks.assign_roles(obs, samples, None).collect()}
    assert bare[3] == bare[4] == bare[5] == ("player", 0) and bare[2] == ("linesman", -1)


@pytest.mark.parametrize("block", [40, 64, 10_000])
def test_running_sums_equal_each_window(spark, block):
    rng = np.random.default_rng(5)
    u = rng.uniform(size=150)
    u[60:110] = 0.25  # for a while nothing varies
    rows = [(m, s, float(u[s]), float(rng.uniform()), float(rng.uniform(-50, 50)), float(rng.uniform(-30, 30))) for m in (0, 1) for s in range(150)]
    refs = spark.createDataFrame(rows, "video_id bigint, seq bigint, u double, v double, pitch_x double, pitch_y double")
    found = {(r.video_id, r.seq): r for r in trajectories.rolling_calibration(refs, 10, 40, block).collect()}
    assert len(found) == len(rows)
    for m, s, *_ in rows:
        part = np.array([r[2:] for r in rows if r[0] == m and max(0, s - 39) <= r[1] <= s])
        got = found[m, s]
        for a, b, p in (("x", 0, 2), ("y", 1, 3)):
            if s < 9 or len(set(part[:, b])) == 1:
                assert got[f"slope_{a}"] is None and got[f"intercept_{a}"] is None
            else:
                slope, at = np.polyfit(part[:, b], part[:, p], 1)
                assert math.isclose(got[f"slope_{a}"], slope, rel_tol=1e-6, abs_tol=1e-6) and math.isclose(got[f"intercept_{a}"], at, rel_tol=1e-6, abs_tol=1e-6)


def test_drawn_grid(spark):
    rows = [(0, 1, 0, -20.0, 3.0, 4.0, -2.0), (0, 1, 1, 15.0, -8.0, 0.0, 0.0), (0, 1, 0, 5.0, 20.0, -9.0, 9.0), (0, 2, 1, 0.0, 0.0, 1.0, 1.0)]
    players = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, team int, x double, y double, vx double, vy double")
    found = {r.frame_idx: r for r in influence.frame_dominance(players).collect()}
    for frame in (1, 2):
        share = lead = 0
        for i in range(287):
            for j in range(195):
                at = [0.0, 0.0]
                for _, f, team, x, y, vx, vy in rows:
                    if f == frame:
                        s, a = min(math.hypot(vx, vy), 8), math.atan2(vy, vx)
                        dx, dy = (4 * i - 50) / 10 - 52.5 - x - vx / 2, 34 - (4 * j - 50) / 10 - y - vy / 2
                        p, q = dx * math.cos(a) + dy * math.sin(a), -dx * math.sin(a) + dy * math.cos(a)
                        at[team] += math.exp(-(p * p / (2 * (4 + s / 2) ** 2) + q * q / (2 * (4 / (1 + s / 10)) ** 2)))
                share += at[0] / (sum(at) + 1e-6) / (287 * 195)
                lead += at[0] > at[1]
        assert math.isclose(found[frame].share_0, share, rel_tol=1e-9, abs_tol=1e-12) and found[frame].cells_0 == lead
