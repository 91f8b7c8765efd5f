"""Velocities and trails as a stream against the batch operators."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from touchline.operators import trajectories
from touchline.plans import motion as plan
from touchline.streaming import matches, motion

SF = os.environ.get("TOUCHLINE_SF", "/root/testdata/sf0.001")
POINTS = "video_id long, track_id string, frame_idx long, x double, y double"


def sent(spark, parts, **options):
    """The stream's rows over micro-batches of these lists of points."""
    base = f"{plan._scratch(spark)}/motion-{uuid.uuid4().hex}"
    for part in parts:
        spark.createDataFrame(part, POINTS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(POINTS).parquet(f"{base}/in")
        query = motion.motion_stream(stream, **options).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").orderBy("track_id", "frame_idx").collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("run", [9, 45, 10_000])
def test_stream_equals_batch_over_any_split(spark, run):
    dense = plan._dense(spark, SF)
    made = matches.run_in_order(dense, lambda df: motion.motion_stream(df, length=7), plan._scratch(spark), run)
    key = ["video_id", "track_id", "frame_idx"]
    speeds = {tuple(r[c] for c in key): (r["vx"], r["vy"]) for r in trajectories.velocities(dense).collect()}
    trails = {tuple(r[c] for c in key): r for r in trajectories.trails(dense.withColumns({"pitch_x": F.col("x"), "pitch_y": F.col("y")}), 7).collect()}
    found = made.collect()
    assert len(found) == len(speeds) == len({tuple(r[c] for c in key) for r in found})
    for r in found:
        at = tuple(r[c] for c in key)
        assert (r["vx"], r["vy"]) == pytest.approx(speeds[at], abs=1e-12)
        t = trails[at]
        assert (r["points"], r["oldest_gray"], r["newest_gray"]) == (t["points"], t["oldest_gray"], t["newest_gray"])
        assert list(zip(r["trail_x"], r["trail_y"], strict=True)) == [(p["pitch_x"], p["pitch_y"]) for p in t["trail"]]


def test_late_missing_and_repeated_points(spark):
    found = sent(spark, [[(1, "A1", 0, 0.0, 0.0), (1, "A1", 2, None, 0.0), (1, "A1", 1, 0.1, 0.0), (1, "A1", 1, 0.2, 0.0)], [(1, "A1", 1, 9.0, 9.0), (1, "A1", 3, 0.2, 0.0)], [(1, "B1", 0, 1.0, 1.0)]], fps=10.0)
    assert [(r["track_id"], r["frame_idx"], r["points"]) for r in found] == [("A1", 0, 1), ("A1", 1, 2), ("A1", 3, 3), ("B1", 0, 1)]
    assert [round(r["vx"], 9) for r in found] == [0.0, 0.3, 0.51, 0.0]


def test_tracks_are_forgotten_by_frames(spark):
    parts = [[(1, "A1", 0, 0.0, 0.0), (1, "A1", 1, 1.0, 0.0)], [(1, "A1", 50, 2.0, 0.0), (1, "A1", 51, 3.0, 0.0)]]
    kept, anew = sent(spark, parts, fps=1.0), sent(spark, parts, fps=1.0, forget=20)
    assert [r["points"] for r in kept] == [1, 2, 3, 4] and [r["points"] for r in anew] == [1, 2, 1, 2]
    assert [round(r["vx"], 9) for r in anew] == [0.0, 0.3, 0.0, 0.3] and kept[2]["vx"] == pytest.approx(0.51)


def test_many_tracks_share_states(spark):
    base = f"{plan._scratch(spark)}/motion-{uuid.uuid4().hex}"
    rows = spark.range(2000).selectExpr("1L as video_id", "cast(id % 1000 as string) as track_id", "id div 1000 as frame_idx", "double(id) as x", "double(-id) as y")
    rows.coalesce(1).write.parquet(f"{base}/in")
    query = motion.motion_stream(spark.readStream.schema(POINTS).parquet(f"{base}/in"), length=1, forget=5, fps=1.0).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) <= motion.SHARES
    found = spark.read.parquet(f"{base}/out").collect()
    assert len(found) == 2000 and {r["points"] for r in found} == {1}
    assert {r["vx"] for r in found if r["frame_idx"] == 0} == {0.0} and all(r["vx"] > 0 > r["vy"] for r in found if r["frame_idx"] == 1)
