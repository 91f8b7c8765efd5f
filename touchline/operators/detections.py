"""Detector output: class scores, labels, overlapping boxes, training targets, samples by frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def softmax_class(rows: DataFrame, logits: str = "logits", least: float = 0.3, wanted: int | None = 0) -> DataFrame:
    """rows with class_id and score of the largest softmax share, above least and of the wanted class."""
    values = F.transform(logits, lambda v: v.cast("double"))
    rows = rows.withColumn("_v", values).withColumn("_top", F.array_max("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top")))
    rows = rows.withColumn("score", 1.0 / total).withColumn("class_id", (F.array_position("_v", F.col("_top")) - 1).cast("int"))
    rows = rows.filter(F.col("score") > least).drop("_v", "_top")
    return rows if wanted is None else rows.filter(F.col("class_id") == wanted)


def named(rows: DataFrame, names: dict[int, str], least: float) -> DataFrame:
    """Detections of at least that score with label; classes without a name are class_<id>."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    label = F.coalesce(F.try_element_at(known, F.col("class_id")), F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return rows.filter(F.col("score") >= least).withColumn("label", label)


def players_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.lower("label").isin("player", "person"))


def suppress(rows: DataFrame, limit: float = 0.45) -> DataFrame:
    """det_id of the boxes that no better box of their frame overlaps by more than limit, best first; a frame in a task."""
    from touchline.operators.tracking import box_iou

    schema = "video_id bigint, frame_idx bigint, det_id bigint"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), ("det_id", "ascending")])
        boxes, left = np.stack([table[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1), np.ones(table.num_rows, dtype=bool)
        kept = []
        for i in range(table.num_rows):
            if left[i]:
                kept.append(i)
                left &= box_iou(boxes[i : i + 1], boxes)[0] <= limit
        out = table.select(["video_id", "frame_idx", "det_id"]).take(kept)
        return out.cast(pa.schema([(n, pa.int64()) for n in out.column_names]))

    return rows.select("video_id", "frame_idx", "det_id", "score", "x1", "y1", "x2", "y2").groupBy("video_id", "frame_idx").applyInArrow(run, schema)


def training_targets(rows: DataFrame, width: float, height: float, class_id: int) -> DataFrame:
    """Proper boxes as normalised centre and size with one class."""
    kept = rows.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return kept.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2 / width, "cy": (F.col("y1") + F.col("y2")) / 2 / height, "w": (F.col("x2") - F.col("x1")) / width, "h": (F.col("y2") - F.col("y1")) / height, "class_id": F.lit(class_id)})


def decoded(rows: DataFrame, width: float, height: float) -> DataFrame:
    """Normalised centre and size as pixel corners."""
    return rows.withColumns({"x1": (F.col("cx") - F.col("w") / 2) * width, "y1": (F.col("cy") - F.col("h") / 2) * height, "x2": (F.col("cx") + F.col("w") / 2) * width, "y2": (F.col("cy") + F.col("h") / 2) * height})


def frame_samples(rows: DataFrame) -> DataFrame:
    """One row per frame with ragged lists of its boxes and track ids, in order of track."""
    item = F.struct("track_id", F.struct("x1", "y1", "x2", "y2").alias("box"))
    out = rows.groupBy("video_id", "frame_idx").agg(F.sort_array(F.collect_list(item)).alias("_i"))
    return out.select("video_id", "frame_idx", F.col("_i.track_id").alias("track_ids"), F.col("_i.box").alias("boxes"))


def video_table(frames: DataFrame, fps: float) -> DataFrame:
    """One row per match: frames, duration in seconds (0 without a rate) and the paths of its frames' images."""
    path = F.format_string("%d/frame_%08d.jpg", "video_id", "frame_idx")
    out = frames.groupBy("video_id").agg(F.count("*").alias("total_frames"), F.sort_array(F.collect_list(path)).alias("frame_paths"))
    return out.withColumn("duration_seconds", F.col("total_frames") / fps if fps else F.lit(0.0))


def timings(calls: DataFrame) -> DataFrame:
    """function, calls, total, longest and mean ms; the largest total first. calls: function, ms."""
    return calls.groupBy("function").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"), F.avg("ms").alias("avg_ms")).orderBy(F.desc("total_ms"), "function")


def records(dets: DataFrame) -> DataFrame:
    """dets with record: the JSON of box, confidence, class and track; no embedding."""
    box = F.array("x1", "y1", "x2", "y2").alias("bbox")
    return dets.withColumn("record", F.to_json(F.struct(box, "confidence", "class_id", "class_name", "track_id"), {"ignoreNullFields": "false"}))
