"""Exports of whole data sets: read back equal, all or nothing."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from touchline.sources import exports, readers

LABELS = {"player": 0, "ball": 2}
BOXES = "video_id long, frame_idx long, track_id long, label string, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture
def boxes(spark):
    made = [(v, 3 * f, t, ("player", "ball", "crowd", None)[(f + t) % 4], 10.0 * t, 5.0 * f, 10.0 * t + 192, 5.0 * f + 108) for v in (1, 2) for f in range(10) for t in range(1 + f % 3)]
    return spark.createDataFrame([*made, (1, None, 1, "ball", 0.0, 0.0, 1.0, 1.0), (1, 3, 9, "ball", None, 0.0, 1.0, 1.0)], BOXES).repartition(5)


def below(folder):
    return sorted(os.path.relpath(os.path.join(at, f), folder) for at, _, files in os.walk(folder) for f in files)


def test_yolo_read_back(spark, boxes, tmp_path):
    folder = f"{tmp_path}/yolo"
    one = boxes.filter("video_id = 1")
    assert exports.export_yolo(one, folder, LABELS, 0.75) == {"total_frames": 10, "train_frames": 7, "val_frames": 3}
    frames = [3 * f for f in range(10)]
    assert [f for f in below(folder) if f.startswith("labels")] == sorted(f"labels/{'train' if f < 21 else 'val'}/frame_{f:08d}.txt" for f in frames)
    assert os.path.isdir(f"{folder}/images/train") and os.path.isdir(f"{folder}/images/val") and not os.path.exists(f"{folder}/_attempts")
    found = {(r["split"], r["image"], r["class_id"], r["cx"], r["w"], r["h"]) for r in readers.read_yolo(spark, f"{folder}/labels").collect()}
    want = one.filter("frame_idx is not null and x1 is not null and label in ('player', 'ball')").collect()
    assert found == {("train" if r["frame_idx"] < 21 else "val", f"frame_{r['frame_idx']:08d}", LABELS[r["label"]], round((r["x1"] + 96) / 1920, 6), 0.1, 0.1) for r in want}
    text = open(f"{folder}/data.yaml").read().splitlines()
    assert text == ["names:", "  0: player", "  2: ball", f"path: {folder}", "train: images/train", "val: images/val"]


def test_coco_read_back(spark, boxes, tmp_path):
    folder = f"{tmp_path}/coco"
    counts = exports.export_coco(boxes, folder, LABELS)
    want = boxes.filter("frame_idx is not null and x1 is not null and label in ('player', 'ball')").orderBy("video_id", "frame_idx", "track_id").collect()
    assert counts == {"images": 20, "annotations": len(want)}
    document = json.load(open(f"{folder}/1.json"))
    assert document["categories"] == [{"id": 0, "name": "player"}, {"id": 2, "name": "ball"}]
    assert [i["id"] for i in document["images"]] == list(range(1, 11)) and document["images"][2] == {"id": 3, "file_name": "frame_00000006.jpg", "width": 1920, "height": 1080}
    assert [a["id"] for a in document["annotations"]] == list(range(1, len(document["annotations"]) + 1)) and {a["iscrowd"] for a in document["annotations"]} == {0}
    found = readers.read_coco(spark, folder).orderBy("file", "annotation_id").collect()
    assert [(int(r["file"]), r["frame"], r["category_id"], r["left"], r["top"], r["width"], r["height"], r["area"]) for r in found] == [
        (r["video_id"], r["frame_idx"], LABELS[r["label"]], r["x1"], r["y1"], 192.0, 108.0, 192.0 * 108) for r in want
    ]


def test_nothing_to_export(spark, boxes, tmp_path):
    none = boxes.limit(0)
    assert exports.export_yolo(none, f"{tmp_path}/a", LABELS) == {"total_frames": 0, "train_frames": 0, "val_frames": 0}
    assert below(f"{tmp_path}/a") == ["_counts.json", "data.yaml"]
    assert exports.export_coco(none, f"{tmp_path}/b", LABELS) == {"images": 0, "annotations": 0} and below(f"{tmp_path}/b") == ["_counts.json"]


def test_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).select(F.format_string("f/%d.txt", "id").alias("name"), F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise("text").alias("body"), F.lit("file").alias("kind"))
    with pytest.raises(PySparkException):
        exports.write_files(rows, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []
    apart = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("a", "3", None)], exports.ROWS).coalesce(1)
    with pytest.raises(PySparkException, match="must come together"):
        exports.write_files(apart, f"{tmp_path}/out")
    with pytest.raises(PySparkException, match="must come together"):
        exports.write_files(apart.limit(1).withColumn("name", F.lit("../a")), f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_overwrite_and_present_folder(spark, tmp_path):
    folder = f"{tmp_path}/out"
    one = spark.createDataFrame([("a.txt", "1", "x"), ("a.txt", "2", "x"), ("b/c.txt", None, None)], exports.ROWS).coalesce(1)
    assert exports.write_files(one, folder) == {"x": 2} and open(f"{folder}/a.txt").read() == "12" and open(f"{folder}/b/c.txt").read() == ""
    with pytest.raises(Exception, match="exists"):
        exports.write_files(one, folder)
    assert exports.write_files(one.filter("name = 'a.txt'"), f"file:{folder}", overwrite=True) == {"x": 2}
    assert below(folder) == ["_counts.json", "a.txt"] and os.listdir(tmp_path) == ["out"]
