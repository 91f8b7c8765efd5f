"""Row filters and frame sampling; all of them reach the scan as pushed predicates or one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pixels of a cell of the picture, and cells that a box spans to meet all balls of its frame.
CELL, LARGE = 64, 16


def confident(detections: DataFrame, least: float, strict: bool) -> DataFrame:
    """Detections above least; strict leaves out those at it."""
    return detections.filter(F.col("score") > least if strict else F.col("score") >= least)


def proper_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def sample_frames(frames: DataFrame, video_fps: float, target_fps: float, start: int = 0, end: int | None = None, most: int | None = None) -> DataFrame:
    """Every int(video_fps / target_fps)-th frame of a match from start, before end, at most so many per match."""
    step = max(1, int(video_fps / target_fps))
    kept = frames.filter((F.col("frame_idx") >= start) & ((F.col("frame_idx") - start) % step == 0))
    kept = kept if end is None else kept.filter(F.col("frame_idx") < end)
    return kept if most is None else kept.filter(F.col("frame_idx") < start + most * step)


def keyframes(levels: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """The first frame of a match, and those whose grey level differs from the last frame's by more than threshold.

    levels: video_id, frame_idx, gray.
    """
    by = Window.partitionBy("video_id").orderBy("frame_idx")
    kept = levels.withColumn("_diff", F.abs(F.col("gray") - F.lag("gray").over(by))).filter(F.coalesce(F.col("_diff") > threshold, F.lit(True)))
    kept = kept.drop("_diff")
    return kept if most is None else kept.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n")


def valid_balls(balls: DataFrame, players: DataFrame) -> DataFrame:
    """Ball boxes of a plausible size and shape; inside the first player's box only at its head or feet.

    balls: video_id, frame_idx, ball_id, x1..y2. players: video_id, frame_idx, player_no, x1..y2.
    A ball meets the players whose boxes touch its cell of the picture, in an equi-join by frame and cell. Boxes of more
    than LARGE cells either way, which would be in too many of them, meet the balls of their frame.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ratio = w / F.greatest(h, F.lit(1.0))
    sized = balls.filter((w <= 50) & (h <= 50) & ratio.between(0.5, 2.0)).withColumn("cx", (F.col("x1") + F.col("x2")) / 2).withColumn("cy", (F.col("y1") + F.col("y2")) / 2)
    boxes = players.select("video_id", "frame_idx", "player_no", *(F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = F.col("cx").between(F.col("px1"), F.col("px2")) & F.col("cy").between(F.col("py1"), F.col("py2"))
    height = F.col("py2") - F.col("py1")
    cell = lambda c: F.floor(F.col(c) / CELL)
    span = lambda a: F.sequence(cell(f"p{a}1"), cell(f"p{a}2"))
    boxes = boxes.filter((F.col("px1") <= F.col("px2")) & (F.col("py1") <= F.col("py2")))  # no other has a place inside
    large = (cell("px2") - cell("px1") >= LARGE) | (cell("py2") - cell("py1") >= LARGE)
    small = boxes.filter(~large).withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    near = sized.withColumns({"_cx": cell("cx"), "_cy": cell("cy")}).join(small, ["video_id", "frame_idx", "_cx", "_cy"]).drop("_cx", "_cy")
    met = near.unionByName(sized.join(boxes.filter(large), ["video_id", "frame_idx"])).filter(inside).withColumn("_ok", (F.col("cy") < F.col("py1") + height * 0.3) | (F.col("cy") > F.col("py1") + height * 0.9))
    verdict = met.groupBy("video_id", "frame_idx", "ball_id").agg(F.min_by("_ok", "player_no").alias("_ok"))
    return sized.join(verdict, ["video_id", "frame_idx", "ball_id"], "left").filter(F.coalesce("_ok", F.lit(True))).drop("_ok", "cx", "cy")
