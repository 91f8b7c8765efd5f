"""Annotation tables: tracks from detections, boxes from tracks, and the export formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.geometry import yolo_box


def tracks_from_detections(dets: DataFrame) -> DataFrame:
    """video_id, track_id, label (of the first detection), frames, boxes."""
    rows = F.sort_array(F.collect_list(F.struct("frame_idx", F.struct("x1", "y1", "x2", "y2").alias("box"))))
    out = dets.groupBy("video_id", "track_id").agg(F.min_by("label", "frame_idx").alias("label"), rows.alias("_r"))
    return out.select("video_id", "track_id", "label", F.col("_r.frame_idx").alias("frames"), F.col("_r.box").alias("boxes"))


def boxes_from_tracks(tracks: DataFrame) -> DataFrame:
    """One annotation per frame of every track, with the track's id as an attribute."""
    rows = tracks.select("video_id", "track_id", "label", F.explode(F.arrays_zip("frames", "boxes")).alias("_r"))
    box = [F.col(f"_r.boxes.{a}").alias(b) for a, b in (("x1", "xtl"), ("y1", "ytl"), ("x2", "xbr"), ("y2", "ybr"))]
    return rows.select("video_id", F.col("_r.frames").alias("frame_idx"), "label", *box, F.create_map(F.lit("track_id"), F.col("track_id").cast("string")).alias("attributes"))


def line_boxes(lines: DataFrame) -> DataFrame:
    """The box around the points (array of x, y) of every line; lines without points are left out."""
    edge = lambda f, c: f(F.transform("points", lambda p: p[c]))
    return lines.filter(F.size("points") > 0).select("frame_id", "class_idx", edge(F.array_min, "x").alias("xtl"), edge(F.array_min, "y").alias("ytl"), edge(F.array_max, "x").alias("xbr"), edge(F.array_max, "y").alias("ybr"), F.size("points").alias("num_points"))


def ordered_split(frames: DataFrame, key: str, ratio: float) -> DataFrame:
    """Distinct keys with split: the first int(n * ratio) of them train.

    Ranks come from counts of blocks of keys and ranks within them, so no task sees all keys.
    """
    distinct = frames.select(key).distinct().withColumn("_block", F.floor(F.col(key) / 4096))
    sizes = distinct.groupBy("_block").count()
    every = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("count").over(every), F.lit(0))).withColumn("_all", F.sum("count").over(Window.partitionBy()))
    rows = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("_block").orderBy(key))).join(sizes, "_block")
    return rows.select(key, F.when(F.col("_ahead") + F.col("_n") <= F.floor(F.col("_all") * ratio), "train").otherwise("val").alias("split"))


def yolo_labels(boxes: DataFrame, width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """frame_key, lines: a label file for every frame; boxes need frame_key, class_id, x1..y2."""
    cx, cy, w, h = yolo_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(width), F.lit(height), clip=False)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", cx, cy, w, h)
    return boxes.groupBy("frame_key").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def parse_yolo(lines: DataFrame, value: str = "value") -> DataFrame:
    """class_id, cx, cy, w, h of label lines with at least five words."""
    parts = F.split(F.trim(value), r"\s+")
    kept = lines.withColumn("_p", parts).filter(F.size("_p") >= 5)
    return kept.select(*(c for c in lines.columns if c != value), F.col("_p")[0].cast("int").alias("class_id"), *(F.col("_p")[k].cast("double").alias(n) for k, n in enumerate(("cx", "cy", "w", "h"), 1)))


def coco_annotations(boxes: DataFrame, labels: dict[str, int]) -> DataFrame:
    """image_id (dense, per match in frame order), annotation_id, category_id, corner, size; unmapped labels have an image but no annotation.

    boxes: video_id, frame_idx, track_id, label, x1..y2.
    """
    category = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col("label")]
    by = Window.partitionBy("video_id")
    rows = boxes.withColumn("image_id", F.dense_rank().over(by.orderBy("frame_idx"))).withColumn("category_id", category)
    kept = rows.filter(F.col("category_id").isNotNull()).withColumn("annotation_id", F.row_number().over(by.orderBy("frame_idx", "track_id")))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return kept.select("video_id", "image_id", "annotation_id", "category_id", F.col("x1").alias("left"), F.col("y1").alias("top"), w.alias("width"), h.alias("height"), (w * h).alias("area"))


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def image_xml(boxes: DataFrame) -> DataFrame:
    """frame_key, xml: an image element for every frame, its boxes in order of their text."""
    box = F.format_string('<box label="%s" xtl="%.2f" ytl="%.2f" xbr="%.2f" ybr="%.2f" occluded="%d"><attribute name="track_id">%s</attribute></box>', _escape(F.col("label")), "x1", "y1", "x2", "y2", F.col("occluded").cast("int"), F.col("track_id").cast("string"))
    body = F.array_join(F.array_sort(F.collect_list(box)), "")
    return boxes.groupBy("frame_key").agg(F.concat(F.format_string('<image id="%d">', F.first("frame_key")), body, F.lit("</image>")).alias("xml"))


def line_keypoints(points: DataFrame, classes: DataFrame, most_line: int = 2, most_circle: int = 12) -> DataFrame:
    """frame_id, class_idx, pt_idx, x, y: lines keep their first 2 points by (x, y), circles their first 12 by position.

    points: frame_id, class_idx, pos, x, y. classes: class_idx, is_circle.
    """
    rows = points.join(F.broadcast(classes), "class_idx")  # one row for each of 28 classes
    order = Window.partitionBy("frame_id", "class_idx").orderBy(F.when(~F.col("is_circle"), F.col("x")), F.when(~F.col("is_circle"), F.col("y")), "pos", "x", "y")
    rows = rows.withColumn("pt_idx", F.row_number().over(order) - 1)
    return rows.filter(F.col("pt_idx") < F.when(F.col("is_circle"), most_circle).otherwise(most_line)).select("frame_id", "class_idx", "pt_idx", "x", "y")
