"""Keypoints and pitch templates: correspondences, overlays, heat maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import geometry as G
from touchline.functions import pitch


def template_table(spark) -> DataFrame:
    """class_idx, class_name, pt_idx, x, y: 23 rows."""
    index = {n: k for k, n in enumerate(pitch.LINE_CLASSES)}
    return spark.createDataFrame([(index[n], n, k, x, y) for n, k, x, y in pitch.template()], "class_idx bigint, class_name string, pt_idx bigint, x double, y double")


def correspondences(keypoints: DataFrame, lines: DataFrame, width: float, height: float, least_line: float = 0.5, least_point: float = 0.5) -> DataFrame:
    """frame_id, class_idx, pt_idx, u, v, x, y of sure and visible keypoints inside the image that the template has.

    keypoints: frame_id, class_idx, pt_idx, kx, ky (0..1), visibility. lines: frame_id, class_idx, confidence.
    """
    sure = lines.filter(F.col("confidence") >= least_line).select("frame_id", "class_idx")
    rows = keypoints.filter(F.col("visibility") >= least_point).join(F.broadcast(template_table(keypoints.sparkSession)), ["class_idx", "pt_idx"])  # 23 rows
    rows = rows.join(sure, ["frame_id", "class_idx"], "left_semi").withColumn("u", F.col("kx") * width).withColumn("v", F.col("ky") * height)
    return rows.filter(F.col("u").between(0, width) & F.col("v").between(0, height)).select("frame_id", "class_idx", "pt_idx", "u", "v", "x", "y")


def overlay(homographies: DataFrame, width: int, height: int, margin: int = 500) -> DataFrame:
    """video_id, frame_idx, class_idx, points: truncated pixels of the template's lines with at least two points near the image."""
    rows = homographies.crossJoin(F.broadcast(template_table(homographies.sparkSession)))  # 23 rows for each frame
    u, v = G.project(G.matrix(), F.col("x"), F.col("y"))
    rows = rows.withColumn("u", u.cast("int")).withColumn("v", v.cast("int"))
    near = (F.col("u") > -margin) & (F.col("u") < width + margin) & (F.col("v") > -margin) & (F.col("v") < height + margin)
    out = rows.filter(near).groupBy("video_id", "frame_idx", "class_idx").agg(F.sort_array(F.collect_list(F.struct("pt_idx", "u", "v"))).alias("points"))
    return out.filter(F.size("points") >= 2)


def line_segments(cameras: DataFrame) -> DataFrame:
    """The 23 lines through each camera (p00..p23): line_idx and truncated pixels of both ends; NULL behind a zero scale."""
    lines = cameras.sparkSession.createDataFrame([(k, *(a - c for a, c in zip(p, (52.5, 34.0, 0.0), strict=True)), *(b - c for b, c in zip(q, (52.5, 34.0, 0.0), strict=True))) for k, (p, q) in enumerate(pitch.LINES_3D)], "line_idx int, ax double, ay double, az double, bx double, by double, bz double")
    rows = cameras.crossJoin(F.broadcast(lines))
    p = G.matrix("p", 3, 4)

    def pixel(end: str) -> list:
        x, y, z = (F.col(f"{end}{c}") for c in "xyz")
        row = [p[i][0] * x + p[i][1] * y + p[i][2] * z + p[i][3] for i in range(3)]
        w = F.nullif(row[2], F.lit(0.0))
        return [(row[k] / w).cast("int").alias(f"{end}_{n}") for k, n in ((0, "u"), (1, "v"))]

    return rows.select(*(c for c in cameras.columns if not (c[0] == "p" and c[1:].isdigit())), "line_idx", *pixel("a"), *pixel("b"))


def point_heat(points: DataFrame, width: int, height: int, sigma: float = 2.0) -> DataFrame:
    """frame_id, class_idx, px, py, heat: the largest Gaussian patch over the points (x, y in 0..1) of a class, inside the map."""
    half = int(6 * sigma + 1) // 2
    around = F.sequence(F.lit(-half), F.lit(half))
    rows = points.select("frame_id", "class_idx", (F.col("x") * width).cast("int").alias("_x"), (F.col("y") * height).cast("int").alias("_y")).distinct()
    rows = rows.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("px", F.col("_x") + F.col("_dx")).withColumn("py", F.col("_y") + F.col("_dy"))
    rows = rows.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    heat = F.exp(-(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / F.lit(2 * sigma * sigma))
    return rows.groupBy("frame_id", "class_idx", "px", "py").agg(F.max(heat).alias("heat"))


def background(heat: DataFrame) -> DataFrame:
    """1 - the largest heat of any class where there is some; 1 elsewhere."""
    return heat.groupBy("frame_id", "px", "py").agg((1 - F.max("heat")).alias("background"))
