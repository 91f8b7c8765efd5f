"""Queries over detections, calibration and colours, and the whole analysis of a match."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import pitch
from touchline.functions.geometry import r6
from touchline.operators import calibration, colours, detections, fragments, trajectories
from touchline.plans import motion, tracking
from touchline.sources import exports, readers
from touchline.sources.fixtures import CTE, homographies, observations, table


def softmax_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double") * 8).alias("logits"))
    return detections.softmax_class(rows, least=0.4, wanted=None).select("vec_id", "class_id", r6(F.col("score")).alias("score"))


def detection_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("class_id", (F.col("event_id") % 6).cast("int"))
    return detections.named(rows, pitch.DETECTOR_CLASSES, 0.5).select("event_id", "label")


def player_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("class_id", (F.col("event_id") % 6).cast("int"))
    return detections.players_only(detections.named(rows, {0: "Player", 1: "PERSON", 2: "referee"}, 0.0)).groupBy("video_id").agg(F.count("*").alias("players"))


def box_suppression(spark: SparkSession, d: str) -> DataFrame:
    return detections.suppress(observations(spark, d).withColumn("det_id", F.col("event_id")), 0.1)


def target_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = detections.decoded(detections.training_targets(observations(spark, d), 1920.0, 1080.0, 1), 960.0, 540.0)
    return rows.select("event_id", "class_id", *(r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")))


def frame_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = detections.frame_samples(observations(spark, d))
    return rows.select("video_id", "frame_idx", F.array_join(F.transform("track_ids", lambda t: t.cast("string")), ",").alias("track_ids"), F.size("boxes").cast("bigint").alias("boxes"))


def video_table(spark: SparkSession, d: str) -> DataFrame:
    rows = detections.video_table(observations(spark, d).select("video_id", "frame_idx").distinct(), 25.0)
    return rows.select("video_id", "total_frames", r6(F.col("duration_seconds")).alias("duration_seconds"), F.array_join("frame_paths", ";").alias("frame_paths"))


def function_timings(spark: SparkSession, d: str) -> DataFrame:
    rows = detections.timings(table(spark, d, "events").select(F.col("event_type").alias("function"), F.floor(F.col("value") * 8).alias("ms")))
    return rows.withColumn("avg_ms", F.round("avg_ms", 4))


def _keypoints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") % 28).alias("class_idx"), (F.col("l_suppkey") % 3).alias("pt_idx"), (F.col("l_discount").cast("double") * 11).alias("kx"), (F.col("l_tax").cast("double") * 12.5).alias("ky"), (F.col("l_quantity") / 50).cast("double").alias("visibility"))


def correspondences(spark: SparkSession, d: str) -> DataFrame:
    lines = _keypoints(spark, d).select("frame_id", "class_idx", (F.col("frame_id") % 10 / 10.0).alias("confidence")).distinct()
    rows = calibration.correspondences(_keypoints(spark, d), lines, 1920.0, 1080.0)
    return rows.select("frame_id", "class_idx", "pt_idx", *(r6(F.col(c)).alias(c) for c in ("u", "v", "x", "y")))


def pitch_overlay(spark: SparkSession, d: str) -> DataFrame:
    rows = calibration.overlay(homographies(spark, d), 1280, 720)
    return rows.select("video_id", "frame_idx", "class_idx", F.size("points").cast("bigint").alias("n"), F.aggregate("points", F.lit(0).cast("bigint"), lambda a, p: a + p["u"] + 3 * p["v"]).alias("checksum"))


def line_projection(spark: SparkSession, d: str) -> DataFrame:
    cameras = tracking._cameras(spark, d).withColumn("p23", F.col("p23") + 50.5)
    return calibration.line_segments(cameras)


def point_heatmap(spark: SparkSession, d: str) -> DataFrame:
    points = _keypoints(spark, d).select((F.col("frame_id") % 11).alias("frame_id"), "class_idx", F.col("kx").alias("x"), F.col("ky").alias("y"))
    return calibration.point_heat(points, 48, 27).select("frame_id", "class_idx", "px", "py", r6(F.col("heat")).alias("heat"))


def background_channel(spark: SparkSession, d: str) -> DataFrame:
    points = _keypoints(spark, d).select((F.col("frame_id") % 7).alias("frame_id"), "class_idx", F.col("kx").alias("x"), F.col("ky").alias("y"))
    return calibration.background(calibration.point_heat(points, 48, 27)).select("frame_id", "px", "py", r6(F.col("background")).alias("background"))


def slot_positions(spark: SparkSession, d: str) -> DataFrame:
    """Slots on every frame of their match from 0 to its last: NULL before they are first seen."""
    seen = motion.slot_frames(spark, d)
    last = seen.groupBy("video_id").agg(F.max("frame_idx").alias("_last"))  # all slots are held to the end of the match
    grid = seen.select("video_id", "slot_key").distinct().join(last, "video_id").select("video_id", "slot_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("frame_idx"))
    return grid.join(seen, ["video_id", "slot_key", "frame_idx"], "left")


def yolo_to_coco(spark: SparkSession, d: str) -> DataFrame:
    """Label lines as annotations in pixels with ids within their split."""
    rows = observations(spark, d).select((F.col("video_id") % 2).alias("split"), (F.col("video_id") * 1000 + F.col("frame_idx")).alias("image"), F.format_string("%d %d %d %d %d", F.col("event_id") % 4, F.floor("x1"), F.floor("y1"), F.lit(2), F.lit(4)).alias("value"))
    from touchline.operators.annotations import parse_yolo

    boxes = parse_yolo(rows)
    # numbers come from a row for each image, and ranks within an image: no task has all boxes of a split
    ahead = Window.partitionBy("split").orderBy("image")
    images = boxes.groupBy("split", "image").agg(F.count("*").alias("_n"))
    images = images.select("split", "image", F.row_number().over(ahead).cast("bigint").alias("image_id"), (F.sum("_n").over(ahead) - F.col("_n")).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("split", "image").orderBy("class_id", "cx", "cy"))
    out = boxes.withColumn("_k", within).join(images, ["split", "image"]).withColumn("annotation_id", F.col("_ahead") + F.col("_k"))
    return out.select("split", "image_id", "annotation_id", F.col("class_id").alias("category_id"), (F.col("cx") - F.col("w") / 2).alias("left"), (F.col("cy") - F.col("h") / 2).alias("top"), "w", "h")


def coco_files(spark: SparkSession, d: str) -> DataFrame:
    """coco_export by way of its files: a document for each match, written in one commit and read back."""
    label = F.when(F.col("event_id") % 3 == 0, "player").when(F.col("event_id") % 3 == 1, "referee").otherwise("other")
    folder = f"{motion._scratch(spark)}/touchline/coco-{uuid.uuid4().hex}"
    exports.export_coco(observations(spark, d).withColumn("label", label), folder, tracking.LABELS)
    rows = readers.read_coco(spark, folder).select(F.col("file").cast("bigint").alias("video_id"), "image_id", "annotation_id", "category_id", "left", "top", "width", "height", "area")
    return rows.withColumns({c: r6(F.col(c)) for c in ("left", "top", "width", "height", "area")})


def colour_features(spark: SparkSession, d: str) -> DataFrame:
    """Jersey colours of crops painted from the embeddings."""
    shade = F.transform(F.sequence(F.lit(0), F.lit(30 * 12 * 3 - 1)), lambda k: F.char((F.pmod(F.floor(F.col("embedding")[(k % 64).cast("int")] * 1000) + k, F.lit(128))).cast("int")))
    crops = table(spark, d, "embeddings").select(F.col("vec_id").alias("crop_id"), F.lit(30).alias("height"), F.lit(12).alias("width"), F.array_join(shade, "").cast("binary").alias("pixels"))
    return colours.features(crops, colours.jersey)


def match_analysis(spark: SparkSession, d: str) -> DataFrame:
    """All passes over all matches: roles and teams, smoothed paths, fragments of a team merged, slots, their places and speeds."""
    motion._scratch(spark)
    obs = observations(spark, d)
    cast = fragments.summaries(obs).join(motion.role_chain(spark, d), ["video_id", "track_id"]).checkpoint()  # a row for each track, read many times
    teams = cast.filter(F.col("team").isin(0, 1))
    rows = cast.join(fragments.components(teams, fragments.parents(teams)).select("video_id", "track_id", "root"), ["video_id", "track_id"], "left").checkpoint()
    frames = fragments.slot_frames(trajectories.smooth_tracks(obs), fragments.slots(rows), rows)
    moving = trajectories.velocities(frames.withColumnRenamed("slot_key", "track_id"))
    return motion._xy(moving, "vx", "vy").select("video_id", F.col("track_id").alias("slot_key"), "frame_idx", "x", "y", "vx", "vy")


QUERIES = {f.__name__: f for f in (softmax_filter, detection_labels, player_labels, box_suppression, target_boxes, frame_samples, video_table, function_timings, correspondences, pitch_overlay, line_projection, point_heatmap, background_channel, slot_positions, yolo_to_coco, coco_files, colour_features, match_analysis)}

_TEMPLATE = "tpl(class_idx, pt_idx, x, y) as (values " + ", ".join(f"({pitch.LINE_CLASSES.index(n)}, {k}, {x!r}::double, {y!r}::double)" for n, k, x, y in pitch.template()) + ")"
_KP = "kp as (select l_orderkey as frame_id, l_partkey % 28 as class_idx, l_suppkey % 3 as pt_idx, l_discount::double * 11 as kx, l_tax::double * 12.5 as ky, (l_quantity / 50)::double as visibility from lineitem)"
_LINES = "ln(line_idx, ax, ay, az, bx, by_, bz) as (values " + ", ".join("(" + ", ".join([str(k), *(f"{v - c!r}::double" for e in line for v, c in zip(e, (52.5, 34.0, 0.0), strict=True))]) + ")" for k, line in enumerate(pitch.LINES_3D)) + ")"
_PATCH = """ds as (select unnest(range(-6, 7))::int as dx), hp as (select p.frame_id, class_idx, cast(trunc(x * 48) as int) + a.dx as px, cast(trunc(y * 27) as int) + b.dx as py, exp(-(a.dx * a.dx + b.dx * b.dx) / 8.0e0) as g from pt p, ds a, ds b),
  heat as (select frame_id, class_idx, px, py, max(g) as heat from hp where px between 0 and 47 and py between 0 and 26 group by 1, 2, 3, 4)"""


def _pixel(end: str, row: int) -> str:
    by = "by_" if end == "b" else "ay"
    scale = f"nullif({end}z + p23, 0)"
    value = (f"f * {end}x + 960 * {end}z + p03", f"f * {by} + 540 * {end}z + p13")[row]
    return f"cast(trunc(({value}) / {scale}) as int) as {end}_{'uv'[row]}"


ORACLES = {
    "coco_files": tracking.ORACLES["coco_export"],
    "softmax_filter": """with l as (select vec_id, list_transform(embedding[1:4], lambda v: v::double * 8) as v from embeddings),
        s as (select vec_id, list_position(v, list_max(v)) - 1 as class_id, 1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) as score from l)
        select vec_id, class_id, round(score, 6) + 0.0 as score from s where score > 0.4""",
    "detection_labels": f"{CTE} select event_id, case event_id % 6 when 0 then 'player' when 1 then 'goalkeeper' when 2 then 'referee' when 3 then 'ball' else 'class_' || (event_id % 6) end as label from obs where score >= 0.5",
    "player_labels": f"{CTE} select video_id, count(*) as players from obs where event_id % 6 < 2 and score >= 0 group by 1",
    "target_boxes": f"{CTE} select event_id, 1 as class_id, round(x1 / 2, 6) + 0.0 as x1, round(y1 / 2, 6) + 0.0 as y1, round(x2 / 2, 6) + 0.0 as x2, round(y2 / 2, 6) + 0.0 as y2 from obs",
    "frame_samples": f"{CTE} select video_id, frame_idx, string_agg(cast(track_id as varchar), ',' order by track_id) as track_ids, count(*) as boxes from obs group by 1, 2",
    "video_table": f"{CTE}, f as (select distinct video_id, frame_idx from obs) select video_id, count(*) as total_frames, round(count(*) / 25.0e0, 6) as duration_seconds, string_agg(printf('%d/frame_%08d.jpg', video_id, frame_idx), ';' order by frame_idx) as frame_paths from f group by 1",
    "function_timings": 'select event_type as "function", count(*) as calls, cast(sum(floor(value * 8)) as bigint) as total_ms, cast(max(floor(value * 8)) as bigint) as max_ms, round(avg(floor(value * 8)), 4) as avg_ms from events group by 1',
    "correspondences": f"with {_TEMPLATE}, {_KP} select frame_id, class_idx, pt_idx, round(kx * 1920, 6) + 0.0 as u, round(ky * 1080, 6) + 0.0 as v, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y from kp join tpl using (class_idx, pt_idx) where visibility >= 0.5 and frame_id % 10 >= 5 and kx * 1920 between 0 and 1920 and ky * 1080 between 0 and 1080",
    "pitch_overlay": f"""{CTE}, {_TEMPLATE}, p as (select video_id, frame_idx, class_idx, cast(trunc(15 * x + h02) as int) as u, cast(trunc(540 - 10 * y) as int) as v from hom, tpl)
        select video_id, frame_idx, class_idx, count(*) as n, cast(sum(u + 3 * v) as bigint) as checksum from p where u > -500 and u < 1780 and v > -500 and v < 1220 group by 1, 2, 3 having count(*) >= 2""",
    "line_projection": f"""with {tracking._CAM_SQL}, c as (select p_partkey, f, {tracking._CAMERA['p03']} as p03, {tracking._CAMERA['p13']} as p13, -pz + 50.5 as p23 from cam), {_LINES}
        select p_partkey, line_idx, {_pixel('a', 0)}, {_pixel('a', 1)}, {_pixel('b', 0)}, {_pixel('b', 1)} from c, ln""",
    "point_heatmap": f"with {_KP}, pt as (select distinct frame_id % 11 as frame_id, class_idx, kx as x, ky as y from kp), {_PATCH} select frame_id, class_idx, px, py, round(heat, 6) + 0.0 as heat from heat",
    "background_channel": f"with {_KP}, pt as (select distinct frame_id % 7 as frame_id, class_idx, kx as x, ky as y from kp), {_PATCH} select frame_id, px, py, round(1 - max(heat), 6) + 0.0 as background from heat group by 1, 2, 3",
    "slot_positions": f"""with sf as ({motion.ORACLES['slot_frames']}), g as (select distinct video_id, slot_key from sf), t as (select g.*, unnest(range(0, total)) as frame_idx from g join (select video_id as lv, max(frame_idx) + 1 as total from sf group by 1) on lv = g.video_id)
        select t.video_id, t.slot_key, t.frame_idx, x, y from t left join sf on sf.video_id = t.video_id and sf.slot_key = t.slot_key and sf.frame_idx = t.frame_idx""",
    "match_analysis": f"""{CTE}, {motion._CHAIN}, {motion._SMOOTH},
        {motion._TRACKS.replace("from frag group by 1, 2)", "from obs join chain using (video_id, track_id) group by 1, 2)").replace("ord as (select *, row_number()", "ord as (select trk.*, role, team, row_number()").replace("from trk)", "from trk join chain using (video_id, track_id))").replace("p.o < c.o and", "p.o < c.o and p.team = c.team and p.team >= 0 and")},
        rol as (select ord.*, root from ord join comp using (video_id, track_id)),
        {motion._SLOTS[motion._SLOTS.index("grp as"):]},
        pl as (select h.video_id, h.frame_idx, h.x, h.y, slot_key, o from h join slt using (video_id, track_id) join ord using (video_id, track_id)),
        e as (select video_id, slot_key, o, max(frame_idx) as f, arg_max(x, frame_idx) as x, arg_max(y, frame_idx) as y from pl group by 1, 2, 3),
        b as (select video_id, slot_key, o, frame_idx, x, y from pl union all select video_id, slot_key, o, unnest(range(f + 1, total)), x, y from e join (select video_id as lv, max(last_frame) + 1 as total from ord group by 1) on lv = video_id),
        dense as (select video_id, slot_key as track_id, frame_idx, arg_max(x, o) as x, arg_max(y, o) as y from b group by 1, 2, 3), {motion._MOVING}
        select video_id, track_id as slot_key, frame_idx, {', '.join(f'round({c} + 1.37e-9, 6) + 0.0 as {c}' for c in ('x', 'y', 'vx', 'vy'))} from vel""",
    "yolo_to_coco": f"""{CTE}, l as (select video_id % 2 as split, video_id * 1000 + frame_idx as image, event_id % 4 as category_id, floor(x1) as cx, floor(y1) as cy from obs)
        select split, dense_rank() over (partition by split order by image) as image_id, row_number() over (partition by split order by image, category_id, cx, cy) as annotation_id, category_id, cx - 1 as "left", cy - 2 as top, 2.0e0 as w, 4.0e0 as h from l""",
}
