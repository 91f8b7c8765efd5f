"""Queries over tracks: statistics, roles, filters, geometry; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import geometry as G
from touchline.functions.geometry import r6
from touchline.operators import annotations, filters, tracks
from touchline.sources.fixtures import CTE, homographies, observations, table

STATS_SQL = """stats as (
  select video_id, track_id, avg(pitch_x) as mean_x, stddev_pop(pitch_x) as std_x, min(pitch_x) as min_x, max(pitch_x) as max_x,
         avg(pitch_y) as mean_y, stddev_pop(pitch_y) as std_y, min(pitch_y) as min_y, max(pitch_y) as max_y,
         cast(count(pitch_x) as bigint) as n_samples
  from obs group by 1, 2 having count(pitch_x) > 0),
roles as (
  select *, case when abs(mean_x) > 36 and std_x < 10 and n_samples > 50 then 'goalie'
                 when abs(mean_y) > 32 and std_y < 5 and n_samples > 50 then 'linesman' else 'player' end as role from stats),
teams as (select *, case when role = 'player' then track_id % 2 else 0 end as team from roles)"""
NUMBERS = ("mean_x", "std_x", "min_x", "max_x", "mean_y", "std_y", "min_y", "max_y")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def position_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tracks.position_stats(observations(spark, d)), *NUMBERS).select("video_id", "track_id", *NUMBERS, "n_samples")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks.roles(tracks.position_stats(observations(spark, d)))
    return rows.withColumn("team", F.when(F.col("role") == "player", F.col("track_id") % 2).otherwise(0))


def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    return tracks.roles(tracks.position_stats(observations(spark, d))).select("video_id", "track_id", "role", F.when(F.col("role") == "goalie", 1).alias("player_id"))


def role_summary(spark: SparkSession, d: str) -> DataFrame:
    return tracks.role_summary(_assigned(spark, d))


def goalie_team(spark: SparkSession, d: str) -> DataFrame:
    return tracks.goalie_teams(_assigned(spark, d)).select("video_id", "track_id", "role", "team")


def referee_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = _assigned(spark, d).filter("role = 'player'").withColumn("outlier_score", (F.col("track_id") * 31 % 17).cast("double")).withColumn("track_ordinal", F.col("track_id"))
    return tracks.pick_referee(rows, least_spread=0.2)


def long_tracks(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks.long_tracks(observations(spark, d), 60)
    return rows.groupBy("video_id", "track_id").agg(F.count("*").alias("observations"))


def track_durations(spark: SparkSession, d: str) -> DataFrame:
    return tracks.durations(observations(spark, d))


def foot_projection(spark: SparkSession, d: str) -> DataFrame:
    h = [[F.lit(v) for v in row] for row in ((1 / 15, 0.0, -64.0), (0.0, -0.1, 54.0), (0.0, 0.00001, 1.0))]
    x, y = G.project(h, *G.foot(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    x, y = G.on_pitch(x, y)
    return observations(spark, d).select("event_id", r6(x).alias("x"), r6(y).alias("y"))


def bbox_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d)
    a = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    made = {}
    for kind in ("xyxy", "xywh", "cxcywh"):
        made |= {f"{kind}_{k}": r6(v) for k, v in enumerate(G.convert_box(a[0], a[1], a[2] / 10, a[3] / 10, kind))}
    return rows.select("event_id", *(v.alias(k) for k, v in made.items()))


def yolo_normalise(spark: SparkSession, d: str) -> DataFrame:
    a = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    made = [v.alias(f"{kind}_{k}") for kind, clip in (("export", False), ("train", True)) for k, v in enumerate(map(r6, G.yolo_box(*a, F.lit(1279.0), F.lit(719.0), clip)))]
    return observations(spark, d).select("event_id", *made)


def _cameras(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", (1000.0 + F.col("p_size")).alias("f"), *((F.col("p_partkey") % m * s).cast("double").alias(n) for n, m, s in (("px", 50, 1.0), ("py", 40, 1.0), ("pz", 30, 1.0))))
    eye = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    p = G.camera(F.col("f"), F.lit(960.0), F.lit(540.0), eye, [F.col("px"), F.col("py"), F.col("pz")])
    return part.select("p_partkey", *(p[i][j].alias(f"p{i}{j}") for i in range(3) for j in range(4)))


def camera_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_cameras(spark, d), *(f"p{i}{j}" for i in range(3) for j in range(4)))


def homography_inverse(spark: SparkSession, d: str) -> DataFrame:
    m = [[F.col(f"p{i}{j}") for j in (0, 1, 3)] for i in range(3)]
    scale = F.when(m[2][2] != 0, m[2][2]).otherwise(1.0)
    h = G.inverse([[v / scale for v in row] for row in m])
    ok = G.determinant(m) != 0
    return _cameras(spark, d).select("p_partkey", ok.alias("ok"), *(r6(h[i][j]).alias(f"h{i}{j}") for i in range(3) for j in range(3)))


def image_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).filter("pitch_x is not null").join(homographies(spark, d), ["video_id", "frame_idx"])
    u, v = G.project(G.matrix(), F.col("pitch_x"), F.col("pitch_y"), least=1e-6)
    return rows.select("event_id", r6(u).alias("u"), r6(v).alias("v"))


def pitch_pixels(spark: SparkSession, d: str) -> DataFrame:
    px, py = G.diagram_pixel(F.col("pitch_x"), F.col("pitch_y"))
    return observations(spark, d).filter((F.abs("pitch_x") <= 57.5) & (F.abs("pitch_y") <= 39)).select("event_id", px.alias("px"), py.alias("py"))


def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d)
    n = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    return n(filters.confident(rows, 0.3, True), "above").join(n(filters.confident(rows, 0.5, False), "at_least"), "video_id")


def _balls(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("x1") + F.col("x2")) / 2, F.col("y1") + (F.col("y2") - F.col("y1")) * ((F.col("event_id") % 10) / 10.0)
    w, h = 10.0 + F.col("event_id") % 50, 10.0 + F.col("event_id") % 30
    rows = observations(spark, d).filter("event_id % 3 = 0").select("video_id", "frame_idx", F.col("event_id").alias("ball_id"), x.alias("cx"), y.alias("cy"), w.alias("w"), h.alias("h"), "score")
    return rows.select("video_id", "frame_idx", "ball_id", "score", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))


def ball_validation(spark: SparkSession, d: str) -> DataFrame:
    players = observations(spark, d).filter("event_id % 3 <> 0").withColumn("player_no", F.col("track_id"))
    return filters.valid_balls(_balls(spark, d), players).select("video_id", "frame_idx", "ball_id")


def degenerate_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("x2", F.col("x2") - F.col("event_id") % 40)
    return filters.proper_boxes(rows).groupBy("video_id").agg(F.count("*").alias("boxes"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("video_id", "frame_idx").agg(F.avg("value").alias("gray"))


def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    return filters.sample_frames(_frames(spark, d), 29.97, 5.0, start=3, end=140, most=20).select("video_id", "frame_idx")


def keyframes(spark: SparkSession, d: str) -> DataFrame:
    return filters.keyframes(_frames(spark, d), 30.0, most=40).select("video_id", "frame_idx")


def colour_class(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).select("event_id", *((F.col("event_id") * k % m).cast("double").alias(n) for n, k, m in (("h", 7, 180), ("s", 11, 256), ("v", 13, 256))))
    return rows.select("event_id", G.colour_class(F.col("h"), F.col("s"), F.col("v")).alias("colour"))


def annotation_tracks(spark: SparkSession, d: str) -> DataFrame:
    dets = observations(spark, d).withColumn("label", F.when(F.col("event_id") % 2 == 0, "player").otherwise("referee"))
    rows = annotations.tracks_from_detections(dets)
    return rows.select("video_id", "track_id", "label", F.size("frames").cast("bigint").alias("n"), F.array_join("frames", ",").alias("frames"), r6(F.get("boxes", F.lit(0))["x1"]).alias("first_x1"))


def annotation_explode(spark: SparkSession, d: str) -> DataFrame:
    dets = observations(spark, d).withColumn("label", F.lit("player"))
    rows = annotations.boxes_from_tracks(annotations.tracks_from_detections(dets))
    return rows.select("video_id", "frame_idx", F.col("attributes")["track_id"].alias("track_id"), *(r6(F.col(c)).alias(c) for c in ("xtl", "ytl", "xbr", "ybr")))


def ordered_split(spark: SparkSession, d: str) -> DataFrame:
    return annotations.ordered_split(observations(spark, d), "frame_idx", 0.8)


LABELS = {"player": 0, "referee": 1}


def yolo_export(spark: SparkSession, d: str) -> DataFrame:
    boxes = observations(spark, d).withColumn("class_id", (F.col("event_id") % 2).cast("int")).withColumn("frame_key", F.col("video_id") * 100000 + F.col("frame_idx"))
    rows = annotations.yolo_labels(boxes)
    return rows.select("frame_key", F.length("lines").cast("bigint").alias("chars"), (F.size(F.split("lines", "\n"))).cast("bigint").alias("n"))


def coco_export(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("event_id") % 3 == 0, "player").when(F.col("event_id") % 3 == 1, "referee").otherwise("other")
    rows = annotations.coco_annotations(observations(spark, d).withColumn("label", label), LABELS)
    return _rounded(rows.withColumns({c: F.col(c).cast("bigint") for c in ("image_id", "annotation_id", "category_id")}), "left", "top", "width", "height", "area")


def cvat_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).select((F.col("video_id") * 100000 + F.col("frame_idx")).alias("frame_key"), "track_id", F.lit("a<b").alias("label"), (F.col("event_id") % 2).alias("occluded"), *(F.floor(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return annotations.image_xml(rows)


QUERIES = {f.__name__: f for f in (role_summary, role_assignment, position_stats, long_tracks, track_durations, goalie_team, referee_pick, foot_projection, bbox_formats, yolo_normalise, camera_matrix, homography_inverse, image_projection, pitch_pixels, confidence_filter, ball_validation, degenerate_boxes, frame_sampling, keyframes, colour_class, annotation_tracks, annotation_explode, ordered_split, yolo_export, coco_export, cvat_xml)}

_R = lambda *names: ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)
_BOX = {
    "xyxy": ("x1", "y1", "x2 / 10", "y2 / 10"),
    "xywh": ("x1", "y1", "x1 + x2 / 10", "y1 + y2 / 10"),
    "cxcywh": ("x1 - x2 / 20", "y1 - y2 / 20", "x1 + x2 / 20", "y1 + y2 / 20"),
}
_YOLO = ("(x1 + x2) / 2 / 1279", "(y1 + y2) / 2 / 719", "(x2 - x1) / 1279", "(y2 - y1) / 719")
_CAMERA = {
    "p00": "f", "p01": "0", "p02": "960", "p03": "-f * px - 960 * pz",
    "p10": "0", "p11": "f", "p12": "540", "p13": "-f * py - 540 * pz",
    "p20": "0", "p21": "0", "p22": "1", "p23": "-pz",
}
_CAM_SQL = "cam as (select p_partkey, 1000.0e0 + p_size as f, cast(p_partkey % 50 as double) as px, cast(p_partkey % 40 as double) as py, cast(p_partkey % 30 as double) as pz from part)"

ORACLES = {
    "position_stats": f"{CTE}, {STATS_SQL} select video_id, track_id, {_R(*NUMBERS)}, n_samples from stats",
    "role_assignment": f"{CTE}, {STATS_SQL} select video_id, track_id, role, case when role = 'goalie' then 1 end as player_id from roles",
    "role_summary": f"{CTE}, {STATS_SQL} select role, team, count(*) as tracks from teams group by grouping sets ((role), (team))",
    "long_tracks": f"{CTE} select video_id, track_id, count(*) as observations from obs group by 1, 2 having count(*) >= 60",
    "track_durations": f"{CTE} select video_id, track_id, count(*) as frames, min(frame_idx) as first_frame, max(frame_idx) as last_frame, round(count(*) / 30.0e0, 6) as seconds from obs group by 1, 2",
    "goalie_team": f"""{CTE}, {STATS_SQL}, sides as (
        select video_id, coalesce(avg(mean_x) filter (where role = 'player' and team = 0), 0) as a, coalesce(avg(mean_x) filter (where role = 'player' and team = 1), 0) as b from teams group by 1)
        select video_id, track_id, role, case when role <> 'goalie' then team when mean_x < 0 then case when a > b then 0 else 1 end else case when a < b then 0 else 1 end end as team
        from teams join sides using (video_id)""",
    "referee_pick": f"""{CTE}, {STATS_SQL}, c as (select *, cast(track_id * 31 % 17 as double) as outlier_score from roles where role = 'player')
        select video_id, track_id, outlier_score from c where outlier_score > 0 and abs(mean_y) <= 30 and std_x + std_y >= 0.2
        qualify row_number() over (partition by video_id order by outlier_score desc, track_id) = 1""",
    "foot_projection": f"""{CTE}, p as (select event_id, (x1 + x2) / 2 as u, y2 as v from obs),
        q as (select event_id, ((1.0e0 / 15) * u - 64) / (1 + 0.00001e0 * v) as x, (54 - 0.1e0 * v) / (1 + 0.00001e0 * v) as y from p)
        select event_id, case when abs(x) <= 115 and abs(y) <= 78 then round(greatest(-57.5, least(57.5, x)), 6) + 0.0 end as x,
               case when abs(x) <= 115 and abs(y) <= 78 then round(greatest(-39, least(39, y)), 6) + 0.0 end as y from q""",
    "bbox_formats": f"{CTE} select event_id, " + ", ".join(f"round({e}, 6) + 0.0 as {k}_{i}" for k, v in _BOX.items() for i, e in enumerate(v)) + " from obs",
    "yolo_normalise": f"{CTE} select event_id, "
    + ", ".join(f"round({e}, 6) + 0.0 as export_{i}" for i, e in enumerate(_YOLO))
    + ", "
    + ", ".join(f"round(greatest(0.0, least(1.0, {e})), 6) + 0.0 as train_{i}" for i, e in enumerate(_YOLO))
    + " from obs",
    "camera_matrix": f"with {_CAM_SQL} select p_partkey, " + ", ".join(f"round(cast({v} as double), 6) + 0.0 as {k}" for k, v in _CAMERA.items()) + " from cam",
    # the matrix [[f, 0, c], [0, f, d], [0, 0, g]] has a triangular inverse
    "homography_inverse": f"""with {_CAM_SQL}, m as (select p_partkey, f, {_CAMERA['p03']} as c, {_CAMERA['p13']} as d, -pz as g from cam),
        s as (select p_partkey, g <> 0 as ok, f / case when g <> 0 then g else 1 end as f, c / case when g <> 0 then g else 1 end as c, d / case when g <> 0 then g else 1 end as d from m)
        select p_partkey, ok, case when ok then round(1 / f, 6) + 0.0 end as h00, case when ok then 0.0e0 end as h01, case when ok then round(-c / f, 6) + 0.0 end as h02,
               case when ok then 0.0e0 end as h10, case when ok then round(1 / f, 6) + 0.0 end as h11, case when ok then round(-d / f, 6) + 0.0 end as h12,
               case when ok then 0.0e0 end as h20, case when ok then 0.0e0 end as h21, case when ok then 1.0e0 end as h22 from s""",
    "image_projection": f"{CTE} select event_id, round(15 * pitch_x + h02, 6) + 0.0 as u, round(540 - 10 * pitch_y, 6) + 0.0 as v from obs join hom using (video_id, frame_idx) where pitch_x is not null",
    "pitch_pixels": f"{CTE} select event_id, cast(trunc(50 + (pitch_x + 52.5) * 10) as int) as px, cast(trunc(50 + (34 - pitch_y) * 10) as int) as py from obs where abs(pitch_x) <= 57.5 and abs(pitch_y) <= 39",
    "confidence_filter": f"{CTE} select video_id, count(*) filter (where score > 0.3) as above, count(*) filter (where score >= 0.5) as at_least from obs group by 1",
    "ball_validation": f"""{CTE}, b as (select video_id, frame_idx, event_id as ball_id, (x1 + x2) / 2 as cx, y1 + (y2 - y1) * ((event_id % 10) / 10.0e0) as cy, 10.0e0 + event_id % 50 as w, 10.0e0 + event_id % 30 as h from obs where event_id % 3 = 0),
        e as (select video_id, frame_idx, ball_id, cx - w / 2 as x1, cy - h / 2 as y1, cx + w / 2 as x2, cy + h / 2 as y2 from b),
        s as (select *, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from e where x2 - x1 <= 50 and y2 - y1 <= 50 and (x2 - x1) / greatest(y2 - y1, 1) between 0.5 and 2),
        m as (select s.video_id, s.frame_idx, ball_id, arg_min(s.cy < p.y1 + (p.y2 - p.y1) * 0.3 or s.cy > p.y1 + (p.y2 - p.y1) * 0.9, p.track_id) as ok
              from s join obs p on p.video_id = s.video_id and p.frame_idx = s.frame_idx and p.event_id % 3 <> 0 and s.cx between p.x1 and p.x2 and s.cy between p.y1 and p.y2 group by 1, 2, 3)
        select s.video_id, s.frame_idx, s.ball_id from s left join m using (video_id, frame_idx, ball_id) where coalesce(ok, true)""",
    "degenerate_boxes": f"{CTE} select video_id, count(*) as boxes from obs where x2 - event_id % 40 > x1 and y2 > y1 group by 1",
    "frame_sampling": f"{CTE} select distinct video_id, frame_idx from obs where frame_idx >= 3 and (frame_idx - 3) % 5 = 0 and frame_idx < 103",
    "keyframes": f"""{CTE}, f as (select video_id, frame_idx, avg(value) as gray from obs group by 1, 2),
        k as (select *, abs(gray - lag(gray) over (partition by video_id order by frame_idx)) as diff from f)
        select video_id, frame_idx from k where coalesce(diff > 30, true) qualify row_number() over (partition by video_id order by frame_idx) <= 40""",
    "colour_class": f"""{CTE}, c as (select event_id, event_id * 7 % 180 as h, event_id * 11 % 256 as s, event_id * 13 % 256 as v from obs)
        select event_id, case when s < 50 then case when v > 180 then 1 when v < 60 then 2 else 0 end
          when h < 15 or h > 165 then 3 when h > 95 and h < 135 then 4 when h > 20 and h < 40 then 5 when h > 40 and h < 85 then 6 else 0 end as colour from c""",
    "annotation_tracks": f"""{CTE} select video_id, track_id, case when arg_min(event_id, frame_idx) % 2 = 0 then 'player' else 'referee' end as label, count(*) as n,
        string_agg(cast(frame_idx as varchar), ',' order by frame_idx) as frames, round(arg_min(x1, frame_idx), 6) + 0.0 as first_x1 from obs group by 1, 2""",
    "annotation_explode": f"{CTE} select video_id, frame_idx, cast(track_id as varchar) as track_id, round(x1, 6) + 0.0 as xtl, round(y1, 6) + 0.0 as ytl, round(x2, 6) + 0.0 as xbr, round(y2, 6) + 0.0 as ybr from obs",
    "ordered_split": f"""{CTE}, f as (select distinct frame_idx from obs), r as (select frame_idx, row_number() over (order by frame_idx) as n, count(*) over () as total from f)
        select frame_idx, case when n <= floor(total * 0.8) then 'train' else 'val' end as split from r""",
    "yolo_export": f"""{CTE}, l as (select video_id * 100000 + frame_idx as frame_key, printf('%d %.6f %.6f %.6f %.6f', event_id % 2, (x1 + x2) / 2 / 1920, (y1 + y2) / 2 / 1080, (x2 - x1) / 1920, (y2 - y1) / 1080) as line from obs)
        select frame_key, sum(length(line)) + count(*) - 1 as chars, count(*) as n from l group by 1""",
    "coco_export": f"""{CTE}, i as (select *, dense_rank() over (partition by video_id order by frame_idx) as image_id from obs)
        select video_id, image_id, row_number() over (partition by video_id order by frame_idx, track_id) as annotation_id, event_id % 3 as category_id,
               round(x1, 6) + 0.0 as "left", round(y1, 6) + 0.0 as top, round(x2 - x1, 6) + 0.0 as width, round(y2 - y1, 6) + 0.0 as height, round((x2 - x1) * (y2 - y1), 6) + 0.0 as area
        from i where event_id % 3 < 2""",
    "cvat_xml": f"""{CTE}, b as (select video_id * 100000 + frame_idx as frame_key,
          printf('<box label="a&lt;b" xtl="%.2f" ytl="%.2f" xbr="%.2f" ybr="%.2f" occluded="%d"><attribute name="track_id">%d</attribute></box>', floor(x1), floor(y1), floor(x2), floor(y2), event_id % 2, track_id) as box from obs)
        select frame_key, '<image id="' || frame_key || '">' || string_agg(box, '' order by box) || '</image>' as xml from b group by 1""",
}
