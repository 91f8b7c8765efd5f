"""Analysis of matches by the command line, against the registered query's steps."""

import pytest
from pyspark.sql import functions as F

from touchline import cli
from touchline.plans import motion, projection
from touchline.sources.fixtures import observations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    boxes = observations(spark, SF).select("video_id", "frame_idx", "track_id", "x1", "y1", "x2", "y2")
    boxes.write.parquet(f"{base}/boxes")
    boxes.withColumn("det_id", F.col("track_id")).drop("track_id").write.parquet(f"{base}/untracked")
    projection._tries(spark, SF).write.parquet(f"{base}/tries")
    motion._colours(spark, SF).select("video_id", "track_id", "colour").write.parquet(f"{base}/colours")
    return base


def test_analyze_writes_all_tables(spark, tables):
    out = tables / "all"
    argv = ["analyze", "--boxes", f"{tables}/boxes", "--homographies", f"{tables}/tries", "--colours", f"{tables}/colours", "--out", str(out), "--dominance"]
    assert cli.main(argv) == 0
    read = {name: spark.read.parquet(f"{out}/{name}") for name in ("placed", "cast", "paths", "dominance")}
    assert read["placed"].count() == observations(spark, SF).count()
    want = {(r["video_id"], r["track_id"], r["frame_idx"]): r["pitch_x"] for r in projection._placed(spark, SF).collect()}
    assert {(r["video_id"], r["track_id"], r["frame_idx"]): r["pitch_x"] for r in read["placed"].collect()} == pytest.approx(want)
    assert read["cast"].select("video_id", "track_id").distinct().count() == read["cast"].count() > 0
    assert read["paths"].groupBy("video_id", "slot_key", "frame_idx").count().filter("count > 1").count() == 0 and read["paths"].count() > 0
    assert read["dominance"].filter("share_0 + share_1 > 1.000001").count() == 0


def test_analyze_finds_tracks_and_keeps_to_the_duration(spark, tables):
    out = tables / "short"
    argv = ["analyze", "--boxes", f"{tables}/untracked", "--homographies", f"{tables}/tries", "--out", str(out), "--duration", "4", "--fps", "10", "--homography-interval", "5"]
    assert cli.main(argv) == 0
    placed = spark.read.parquet(f"{out}/placed")
    assert placed.agg(F.max("frame_idx")).first()[0] < 40 and placed.filter("track_id is null").count() == 0 and placed.count() > 0


def test_dataset_command(spark, tmp_path, capsys):
    for name in ("one", "two"):
        assert cli.main(["dataset", "--base", str(tmp_path), "--create", name, "--format", "coco"]) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["one\tcoco\t0\t0", "two\tcoco\t0\t0"]
    with pytest.raises(ValueError, match="exists"):
        cli.main(["dataset", "--base", str(tmp_path), "--create", "one"])
