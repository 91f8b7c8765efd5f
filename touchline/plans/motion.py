"""Queries over trajectories, fragments, space and data sets; each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import pitch
from touchline.functions.geometry import r6
from touchline.operators import annotations, datasets, fragments, influence, mixture, tracking, tracks, trajectories
from touchline.plans.tracking import STATS_SQL
from touchline.sources.fixtures import CTE, homographies, observations, table
from touchline.sources.fixtures import fragments as fragment_rows


def _xy(df: DataFrame, *more: str) -> DataFrame:
    """Positions at six decimals; the offset keeps halves from being rounded either way."""
    return df.withColumns({c: r6(F.col(c) + 1.37e-9) for c in ("x", "y", *more)})


def assignment_join(spark: SparkSession, d: str) -> DataFrame:
    known = tracks.roles(tracks.position_stats(observations(spark, d))).filter("track_id % 5 <> 0").select("video_id", "track_id", "role")
    rows = observations(spark, d).join(known, ["video_id", "track_id"], "left")
    return rows.groupBy("video_id", "frame_idx", F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("players"))


def asof_homography(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectories.asof_homography(observations(spark, d).select("video_id", "frame_idx", "event_id"), homographies(spark, d))
    return rows.select("event_id", r6(F.col("h02")).alias("h02"), F.col("age"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    noise = (F.col("event_id") % 13) - 6
    return observations(spark, d).select("video_id", F.col("event_id").alias("seq"), ((F.col("x1") + F.col("x2")) / 2 / 1920 + noise / 1920.0).alias("u"), (F.col("y2") / 1080 + noise / 1080.0).alias("v"), "pitch_x", "pitch_y")


def rolling_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectories.rolling_calibration(_references(spark, d).filter("pitch_x is not null"))
    return rows.select("seq", *(F.round(c, 4).alias(c) for c in ("slope_x", "intercept_x", "slope_y", "intercept_y")))


def asof_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectories.calibrated_positions(_references(spark, d))
    return rows.select("seq", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("est_x", "est_y")))


def outlier_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectories.outliers(observations(spark, d).filter("pitch_x is not null"))
    return rows.groupBy("video_id", "track_id").agg(F.count("*").alias("points"), F.sum(F.col("is_outlier").cast("bigint")).alias("outliers"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.fill_gaps(observations(spark, d).filter("pitch_x is not null"))


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return _xy(_dense(spark, d))


def gaussian_smooth(spark: SparkSession, d: str) -> DataFrame:
    return _xy(trajectories.gaussian_smooth(_dense(spark, d), 7.0))


def velocity_clamp(spark: SparkSession, d: str) -> DataFrame:
    return _xy(trajectories.clamp_velocity(_dense(spark, d)))


def smooth_full(spark: SparkSession, d: str) -> DataFrame:
    return _xy(trajectories.smooth_tracks(observations(spark, d)))


def slot_velocity(spark: SparkSession, d: str) -> DataFrame:
    return _xy(trajectories.velocities(_dense(spark, d)), "vx", "vy").select("video_id", "track_id", "frame_idx", "vx", "vy")


def trails(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectories.trails(observations(spark, d).filter("pitch_x is not null"), 20)
    return rows.select("event_id", F.col("points").cast("bigint").alias("points"), r6(F.get("trail", F.lit(0))["pitch_x"]).alias("oldest_x"), "oldest_gray", "newest_gray")


def heatmap_ema(spark: SparkSession, d: str) -> DataFrame:
    cells = observations(spark, d).filter("pitch_x is not null").groupBy("video_id", (F.floor((F.col("pitch_x") + 60) / 40)).alias("cell"), "frame_idx").agg(F.count("*").cast("double").alias("x"))
    rows = trajectories.heat_average(cells)
    return rows.select("video_id", "cell", "frame_idx", r6(F.col("level")).alias("level"))


def colour_memo(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectories.colour_memo(observations(spark, d).withColumn("colour", (F.col("event_id") * 7 % 11 % 4).cast("int")))
    return rows.select("event_id", "memo")


def frame_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fragments.frame_pairs(observations(spark, d)).withColumn("iou", r6(F.col("iou")))


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return fragments.summaries(fragment_rows(spark, d))


def fragment_candidates(spark: SparkSession, d: str) -> DataFrame:
    return fragments.candidates(_tracks(spark, d)).select("video_id", "child", "parent", r6(F.col("score")).alias("score"))


def fragment_parents(spark: SparkSession, d: str) -> DataFrame:
    _scratch(spark)
    return fragments.parents(_tracks(spark, d)).select("video_id", "child", "parent")


def _components(spark: SparkSession, d: str) -> DataFrame:
    _scratch(spark)
    rows = _tracks(spark, d)
    return fragments.components(rows, fragments.parents(rows))


def fragment_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).select("video_id", "track_id", "root")


def _roles(rows: DataFrame) -> DataFrame:
    role = F.when(F.col("root") % 19 == 0, "goalie").when(F.col("root") % 23 == 0, "linesman").when(F.col("root") % 29 == 0, "referee").otherwise("player")
    return rows.withColumn("role", role).withColumn("team", (F.col("root") % 2).cast("int"))


def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = _roles(_components(spark, d))
    out = fragments.slot_summary(rows, fragments.slots(rows))
    return out.select("video_id", "slot_key", F.array_join("tracks", ",").alias("tracks"), "observations", "main_track", "is_goalie")


def slot_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = _roles(_components(spark, d))
    dense = trajectories.fill_gaps(fragment_rows(spark, d).filter("pitch_x is not null"))
    return _xy(fragments.slot_frames(dense, fragments.slots(rows), rows))


MEANS, VARIANCES, WEIGHTS = [[0.05] * 6, [-0.05] * 6], [[0.02] * 6, [0.03] * 6], [0.6, 0.4]


def _colours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), F.slice("embedding", 1, 6).alias("colour"))
    return observations(spark, d).withColumn("_v", F.col("event_id") % F.lit(vectors.count())).join(vectors, "_v").drop("_v")


def colour_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks.colour_votes(_colours(spark, d), MEANS, VARIANCES, WEIGHTS)
    return rows.select("video_id", "track_id", "team", F.round("confidence", 5).alias("confidence"), F.round("outlier_score", 5).alias("outlier_score"), "votes")


def colour_gmm(spark: SparkSession, d: str) -> DataFrame:
    model = mixture.fit(_colours(spark, d), 6)
    rows = tracks.colour_votes(_colours(spark, d), model["means"], model["variances"], model["weights"])
    return rows.select("video_id", "track_id", "team", "confidence")


def role_chain(spark: SparkSession, d: str) -> DataFrame:
    """Roles and teams of all tracks by the whole chain: places, colours, referee, sides of the goalkeepers."""
    return tracks.assign_roles(observations(spark, d), _colours(spark, d), {"means": MEANS, "variances": VARIANCES, "weights": WEIGHTS}, least_spread=0.2)


def role_chain_fitted(spark: SparkSession, d: str) -> DataFrame:
    """The chain with a colour mixture fitted to the placed players."""
    obs, samples = observations(spark, d), _colours(spark, d)
    return tracks.assign_roles(obs, samples, mixture.fit(tracks.placed_players(obs, samples), 6), least_spread=0.2)


def reid_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return datasets.nearest_histograms(queries, rows, 5).select("query_id", "vec_id", "similarity")


def _players(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectories.velocities(_dense(spark, d))
    return rows.withColumn("team", (F.col("track_id") % 2).cast("int"))


def team_influence(spark: SparkSession, d: str) -> DataFrame:
    rows = influence.influence(_players(spark, d))
    return rows.withColumn("influence", F.round("influence", 4) + 0.0)


def dominance_share(spark: SparkSession, d: str) -> DataFrame:
    rows = influence.dominance(influence.influence(_players(spark, d)))
    return rows.groupBy("video_id", "frame_idx").agg(F.round(F.avg("share_0"), 4).alias("share_0"), F.round(F.avg("share_1"), 4).alias("share_1"))


def dominance_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean shares of both teams on every frame, over the 287 x 195 cells of the drawn grid."""
    return influence.frame_dominance(_players(spark, d))


def dominance_averaged(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the teams' running averages on every frame, over the cells of the drawn grid that are on the pitch."""
    return influence.averaged_dominance(_players(spark, d))


def motion_plan(spark: SparkSession, d: str) -> DataFrame:
    """Trails and arrows, counted and summed by track and kind."""
    rows = influence.motion_plan(trajectories.velocities(_dense(spark, d)))
    total = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    return rows.groupBy("video_id", "track_id", "kind").agg(F.count("*").alias("n"), *(total(c) for c in ("px", "py", "gray")))


def line_heatmap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("frame_id"), (F.col("l_partkey") % 28).alias("class_idx"), *((F.col(c) % m).cast("double").alias(n) for c, m, n in (("l_partkey", 40, "ax"), ("l_suppkey", 30, "ay"), ("l_orderkey", 40, "bx"), ("l_quantity", 30, "by"))))
    heat = influence.line_heat(rows)
    return heat.select("frame_id", "class_idx", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), r6(F.col("heat")).alias("heat"))


def render_plan(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("track_id") % 7 == 0, "goalie").when(F.col("track_id") % 11 == 0, "referee").otherwise("player")
    slot = F.when(F.col("track_id") % 3 == 0, F.concat(F.lit("T0_"), F.col("track_id")))
    return influence.render_plan(observations(spark, d).select("video_id", "frame_idx", "track_id", F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y"), role.alias("role"), slot.alias("slot_key"), (F.col("track_id") % 4 - 1).cast("int").alias("team")))


def line_bbox(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") % 28).alias("class_idx"), F.struct((F.col("l_discount").cast("double") * 10).alias("x"), (F.col("l_tax").cast("double") * 12.5).alias("y")).alias("p"))
    rows = annotations.line_boxes(points.groupBy("frame_id", "class_idx").agg(F.collect_list("p").alias("points")))
    return rows.select("frame_id", "class_idx", *(r6(F.col(c)).alias(c) for c in ("xtl", "ytl", "xbr", "ybr")), F.col("num_points").cast("bigint").alias("num_points"))


def line_keypoints(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.createDataFrame([(k, n in pitch.CIRCLES) for k, n in enumerate(pitch.LINE_CLASSES)], "class_idx bigint, is_circle boolean")
    points = table(spark, d, "lineitem").select((F.col("l_orderkey") % 3000).alias("frame_id"), (F.col("l_partkey") % 28).alias("class_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_discount").cast("double") * 10).alias("x"), (F.col("l_tax").cast("double") * 12.5).alias("y"))
    rows = annotations.line_keypoints(points, classes)
    return rows.select("frame_id", "class_idx", F.col("pt_idx").cast("bigint").alias("pt_idx"), r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("dataset"), F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("img_"), (F.col("o_orderkey") % 5000).cast("string")).alias("image"), F.col("o_orderpriority").alias("class_name"), "o_orderkey")


def dataset_merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return datasets.merge(_labels(spark, d)).select("image", "dataset", "split", "class_name", "o_orderkey")


def dataset_stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    return datasets.statistics(_labels(spark, d))


def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return datasets.class_distribution(_labels(spark, d))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("path", F.concat(F.lit("f_"), F.col("video_id").cast("string"), F.lit("_"), F.col("frame_idx").cast("string")))
    return rows.groupBy("path").agg(F.count("*").alias("n_boxes"), F.collect_list(F.when(F.col("event_id") % 4 == 0, F.lit(0.25)).when(F.col("event_id") % 4 == 1, F.lit(0.75))).alias("boxes"), F.sum(F.col("event_id") * 7919 % 10007).alias("key"))


def uncertainty_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = datasets.top(datasets.uncertainty(_predictions(spark, d)).withColumn("uncertainty", r6(F.col("uncertainty"))), 25, F.desc("uncertainty"), F.asc("path"))
    return rows.select("path", "uncertainty")


def stratified_select(spark: SparkSession, d: str) -> DataFrame:
    return datasets.stratified(_predictions(spark, d), 30, F.col("key")).select("path", "bin")


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return datasets.hash_split(_predictions(spark, d), (F.col("key") % 1000) / 1000.0, 0.8).select("path", "split")


def exact_split(spark: SparkSession, d: str) -> DataFrame:
    return datasets.exact_split(_predictions(spark, d), 0.8).select("path", "split")


def video_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/videos/"), F.col("source"), F.lit("/Match Day "), F.col("doc_id").cast("string"), F.lit(" Final Cut.mp4")).alias("path"))
    return datasets.video_ids(rows).select("doc_id", "video_id")


def output_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/videos/"), F.col("source"), F.lit(".v1.mp4")).alias("path"))
    return datasets.output_paths(rows, "analyzed", "out", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 90)).select("doc_id", "output")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).withColumn("det_id", F.col("event_id"))


def iou_tracker(spark: SparkSession, d: str) -> DataFrame:
    return tracking.track_boxes(_detections(spark, d))


def _scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streams; where none is set a local one, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def streaming_tracker(spark: SparkSession, d: str) -> DataFrame:
    """The box tracker fed as a stream: the detections written once, read run by run in frame order by one query."""
    from touchline.streaming.matches import run_in_order
    from touchline.streaming.tracker import track_stream

    dets = _detections(spark, d).select("video_id", "frame_idx", "det_id", "x1", "y1", "x2", "y2")
    return run_in_order(dets, track_stream, _scratch(spark), 45)


def sequence_stream(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by way of ground truth files, a sequence for each minute of a match, read as one stream."""
    from touchline.sources.exports import write_files
    from touchline.streaming.sequences import read_sequences

    base = f"{_scratch(spark)}/touchline/sequences-{uuid.uuid4().hex}"
    cells = ["frame_idx", "track_id", "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), "score"]
    name = F.format_string("%d_%06d/gt/gt.txt", F.col("video_id").cast("long"), F.floor(F.col("frame_idx") / 1500))
    lines = observations(spark, d).select(name.alias("name"), "frame_idx", "track_id", F.concat(F.concat_ws(",", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells)), F.lit("\n")).alias("body"), F.lit("boxes").alias("kind"))
    write_files(lines.repartition("name").sortWithinPartitions("name", "frame_idx", "track_id"), f"{base}/in")
    query = read_sequences(spark, f"{base}/in").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.select("seq_name", F.col("frame").cast("long").alias("frame"), F.col("track_id").cast("long").alias("track_id"), *(F.round(c, 4).alias(c) for c in "xywh"))


QUERIES = {
    f.__name__: f
    for f in (
        assignment_join, asof_homography, rolling_calibration, asof_calibration, outlier_flags, gap_fill, gaussian_smooth, velocity_clamp, smooth_full, slot_velocity, trails,
        heatmap_ema, colour_memo, frame_iou_pairs, fragment_candidates, fragment_parents, fragment_components, slot_assignment, slot_frames, colour_vote, colour_gmm, role_chain, role_chain_fitted, dominance_grid, motion_plan,
        reid_similarity_topk, team_influence, dominance_share, line_heatmap, render_plan, line_bbox, line_keypoints, dataset_merge_dedupe, dataset_stats_rollup, class_distribution,
        uncertainty_topk, stratified_select, hash_split, exact_split, dominance_averaged, video_id, output_path, iou_tracker, streaming_tracker, sequence_stream,
    )
}

_POINTS = "pts as (select video_id, track_id, frame_idx, pitch_x as x, pitch_y as y from obs where pitch_x is not null)"


def _fill(source: str, name: str) -> str:
    return f"""{name}_n as (select *, lead(frame_idx) over w as f2, lead(x) over w as x2, lead(y) over w as y2 from {source} window w as (partition by video_id, track_id order by frame_idx)),
      {name} as (select video_id, track_id, f as frame_idx, case when f = frame_idx then x else x + (f - frame_idx) / cast(f2 - frame_idx as double) * (x2 - x) end as x,
                        case when f = frame_idx then y else y + (f - frame_idx) / cast(f2 - frame_idx as double) * (y2 - y) end as y
                 from (select *, unnest(range(frame_idx, coalesce(f2, frame_idx + 1))) as f from {name}_n))"""


def _smooth(source: str, name: str, sigma: float) -> str:
    radius = int(4 * sigma + 0.5)
    return f"""{name}_i as (select video_id, track_id, frame_idx, x, y, row_number() over (partition by video_id, track_id order by frame_idx) - 1 as i, count(*) over (partition by video_id, track_id) as n from {source}),
      {name}_k as (select k, exp(-0.5e0 * (k / {sigma}e0) * (k / {sigma}e0)) as w from (select unnest(range(-{radius}, {radius + 1})) as k)),
      {name}_j as (select a.video_id, a.track_id, a.frame_idx, w, n, ((i + k) % (2 * n) + 2 * n) % (2 * n) as m from {name}_i a, {name}_k),
      {name} as (select j.video_id, j.track_id, j.frame_idx, sum(w * s.x) / sum(w) as x, sum(w * s.y) / sum(w) as y
                 from {name}_j j join {name}_i s on s.video_id = j.video_id and s.track_id = j.track_id and s.i = case when m < j.n then m else 2 * j.n - 1 - m end group by 1, 2, 3)"""


def _clamp(source: str, name: str, back: bool) -> str:
    order = "desc" if back else "asc"
    reach = f"({pitch.MAX_SPEED}e0 / {pitch.FPS}e0)"
    step = f"least(1.0e0, {reach} / nullif(sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)), 0))"
    return f"""{name}_i as (select video_id, track_id, frame_idx, x, y, row_number() over (partition by video_id, track_id order by frame_idx {order}) as i from {source}),
      {name} as (select video_id, track_id, frame_idx, i, x, y from {name}_i where i = 1
                 union all select s.video_id, s.track_id, s.frame_idx, s.i, c.x + (s.x - c.x) * coalesce({step}, 1.0e0), c.y + (s.y - c.y) * coalesce({step}, 1.0e0)
                 from {name} c join {name}_i s on s.video_id = c.video_id and s.track_id = c.track_id and s.i = c.i + 1)"""


_OUT = """spd as (select *, lag(frame_idx) over w as fa, lag(x) over w as xa, lag(y) over w as ya, lead(frame_idx) over w as fb, lead(x) over w as xb, lead(y) over w as yb from {source} window w as (partition by video_id, track_id order by frame_idx)),
  flag as (select *, coalesce(sqrt((x - xa) * (x - xa) + (y - ya) * (y - ya)) / (frame_idx - fa) > 0.5 and sqrt((x - xb) * (x - xb) + (y - yb) * (y - yb)) / (fb - frame_idx) > 0.5, false) as bad from spd)"""
_KEYS = "video_id, track_id, frame_idx"
_END = f"{_KEYS}, round(x + 1.37e-9, 6) + 0.0 as x, round(y + 1.37e-9, 6) + 0.0 as y"

_MOVING = """raw as (select *, row_number() over w as i, coalesce((x - lag(x) over w) * 30, 0) as rx, coalesce((y - lag(y) over w) * 30, 0) as ry from dense window w as (partition by video_id, track_id order by frame_idx)),
  vel as (select video_id, track_id, frame_idx, i, x, y, 0.0e0 as vx, 0.0e0 as vy from raw where i = 1
          union all select video_id, track_id, frame_idx, i, x, y, ex * k, ey * k from (
            select *, case when sqrt(ex * ex + ey * ey) > 10 then 10 / sqrt(ex * ex + ey * ey) else 1.0e0 end as k from (
              select r.video_id, r.track_id, r.frame_idx, r.i, r.x, r.y, 0.7e0 * v.vx + 0.3e0 * r.rx as ex, 0.7e0 * v.vy + 0.3e0 * r.ry as ey
              from vel v join raw r on r.video_id = v.video_id and r.track_id = v.track_id and r.i = v.i + 1)))"""
_VELOCITY = f"{_POINTS}, {_fill('pts', 'dense')}, {_MOVING}"

_REFS = "refs as (select video_id, event_id as seq, (x1 + x2) / 2 / 1920 + (event_id % 13 - 6) / 1920.0e0 as u, y2 / 1080 + (event_id % 13 - 6) / 1080.0e0 as v, pitch_x, pitch_y from obs)"
_FITS = """fits as (select *, row_number() over w as n, {0} from refs where pitch_x is not null
  window w as (partition by video_id order by seq), l as (partition by video_id order by seq rows between 199 preceding and current row))""".format(
    ", ".join(f"regr_{f}(pitch_{a}, {b}) over l as {f}_{a}" for a, b in (("x", "u"), ("y", "v")) for f in ("slope", "intercept"))
)
_FIT_NAMES = ("slope_x", "intercept_x", "slope_y", "intercept_y")

_TRACKS = """trk as (select video_id, track_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame, count(*) as n,
    arg_min((x1 + x2) / 2, frame_idx) as hx, arg_min((y1 + y2) / 2, frame_idx) as hy, arg_min(y2 - y1, frame_idx) as hh,
    arg_max((x1 + x2) / 2, frame_idx) as tx, arg_max((y1 + y2) / 2, frame_idx) as ty, arg_max(y2 - y1, frame_idx) as th from frag group by 1, 2),
  ord as (select *, row_number() over (partition by video_id order by first_frame, track_id) as o from trk),
  cand as (select c.video_id, c.track_id as child, p.track_id as parent, p.o as po, c.first_frame - p.last_frame as gap,
             sqrt((c.hx - p.tx) * (c.hx - p.tx) + (c.hy - p.ty) * (c.hy - p.ty)) as dist, greatest(c.hh, p.th) / greatest(least(c.hh, p.th), 1) as ratio
           from ord c join ord p on p.video_id = c.video_id and p.o < c.o and c.first_frame - p.last_frame between 0 and 30),
  scored as (select *, gap + 0.5e0 * dist + 50 * (ratio - 1) as score from cand where dist <= 150 and ratio <= 1.5),
  par as (select * from scored qualify row_number() over (partition by video_id, child order by score, po) = 1),
  comp as (select video_id, track_id, track_id as root from ord where not exists (select 1 from par where par.video_id = ord.video_id and child = track_id)
           union all select par.video_id, par.child, comp.root from comp join par on par.video_id = comp.video_id and par.parent = comp.track_id)"""
_SLOTS = """rol as (select ord.*, root, root % 2 as team, case when root % 19 = 0 then 'goalie' when root % 23 = 0 then 'linesman' when root % 29 = 0 then 'referee' else 'player' end as role
           from ord join comp using (video_id, track_id)),
  grp as (select video_id, team, root, sum(n) as total, min(o) as first_o from rol where role in ('goalie', 'player') group by 1, 2, 3),
  rnk as (select *, row_number() over (partition by video_id, team order by total desc, first_o) - 1 as k from grp),
  slt as (select r.video_id, r.track_id, 'T' || r.team || '_' || k as slot_key from rol r join rnk g on g.video_id = r.video_id and g.team = r.team and g.root = r.root where k < 11 and role in ('goalie', 'player')
          union all select video_id, arg_min(track_id, o), 'REF' from rol where role = 'referee' group by 1)"""


def _log_density(k: int) -> str:
    terms = " ".join(f"- 0.5e0 * (ln(2 * 3.141592653589793e0 * {v}e0) + (embedding[{d + 1}]::double - ({m}e0)) * (embedding[{d + 1}]::double - ({m}e0)) / {v}e0)" for d, (m, v) in enumerate(zip(MEANS[k], VARIANCES[k], strict=True)))
    return f"ln({WEIGHTS[k]}e0) {terms}"


_INFLUENCE = f"""{_VELOCITY},
  pl as (select *, track_id % 2 as team, least(sqrt(vx * vx + vy * vy), 8) as s, atan2(vy, vx) as a, x + 0.5e0 * vx as mx, y + 0.5e0 * vy as my from vel ),
  grid as (select gx, gy, (gx + 0.5e0) * 5 - 52.5 as cx, (gy + 0.5e0) * 5 - 34 as cy from (select unnest(range(0, 21)) as gx), (select unnest(range(0, 13)) as gy)),
  inf as (select video_id, frame_idx, team, gx, gy, sum(exp(-(
      ((cx - mx) * cos(a) + (cy - my) * sin(a)) * ((cx - mx) * cos(a) + (cy - my) * sin(a)) / (2 * (4 + 0.5e0 * s) * (4 + 0.5e0 * s))
      + ((cy - my) * cos(a) - (cx - mx) * sin(a)) * ((cy - my) * cos(a) - (cx - mx) * sin(a)) / (2 * (4 / (1 + 0.1e0 * s)) * (4 / (1 + 0.1e0 * s)))))) as influence from pl, grid group by 1, 2, 3, 4, 5)"""
_SMOOTH = f"""cnt as (select video_id, track_id, count(*) as n, count(pitch_x) as p from obs group by 1, 2 having count(*) >= 10 and count(pitch_x) >= 5),
        {_POINTS}, used as (select pts.* from pts join cnt using (video_id, track_id)), {_OUT.format(source='used')},
        good as (select video_id, track_id, frame_idx, x, y from flag where not bad qualify count(*) over (partition by video_id, track_id) >= 5),
        {_fill('good', 'filled')}, {_smooth('filled', 'g', 7.0)}, {_clamp('g', 'ahead', False)}, {_clamp('ahead', 'back', True)}, {_smooth('back', 'h', 3.5)}"""
_VOTES = f"""vd as (select video_id, track_id, 1 / (1 + exp(({_log_density(1)}) - ({_log_density(0)}))) as p from obs join embeddings on vec_id = event_id % (select count(*) from embeddings)),
  vv as (select *, case when p >= 0.5 then 0 else 1 end as t, greatest(p, 1 - p) as c from vd),
  vs as (select video_id, track_id, sum(case when t = 0 then c else 0 end) as a, sum(case when t = 1 then c else 0 end) as b, avg(-ln(c + 1e-10)) as o, count(*) as votes from vv group by 1, 2)"""
_CHAIN = f"""{STATS_SQL}, {_VOTES}, seen as (select video_id, track_id, min(frame_idx) as f from obs group by 1, 2 having count(*) >= 30),
  cast_ as (select r.video_id, r.track_id, role, mean_x, mean_y, std_x, std_y, f, coalesce(case when b > a then 1 else 0 end, 0) as team, coalesce(o, 0) as score from roles r join seen using (video_id, track_id) left join vs using (video_id, track_id)),
  ref as (select video_id, track_id from cast_ where role = 'player' and score > 0 and abs(mean_y) <= 30 and std_x + std_y >= 0.2 qualify row_number() over (partition by video_id order by score desc, f, track_id) = 1),
  named as (select c.*, case when exists (select 1 from ref where ref.video_id = c.video_id and ref.track_id = c.track_id) then 'referee' else role end as part from cast_ c),
  side as (select video_id, coalesce(avg(mean_x) filter (where part = 'player' and team = 0), 0) as s0, coalesce(avg(mean_x) filter (where part = 'player' and team = 1), 0) as s1 from named group by 1),
  chain as (select video_id, track_id, part as role, cast(case when part in ('linesman', 'referee') then -1 when part = 'player' then team when mean_x < 0 then case when s0 > s1 then 0 else 1 end else case when s0 < s1 then 0 else 1 end end as int) as team,
    case when part = 'goalie' then 1 end as player_id from named join side using (video_id))"""
_LABELS = "lab as (select o_custkey % 3 as dataset, case when o_orderkey % 5 = 0 then 'val' else 'train' end as split, 'img_' || (o_orderkey % 5000) as image, o_orderpriority as class_name, o_orderkey from orders)"
_PRED = """pred as (select 'f_' || video_id || '_' || frame_idx as path, count(*) as n_boxes, list(case event_id % 4 when 0 then 0.25e0 when 1 then 0.75e0 end) filter (where event_id % 4 < 2) as boxes, sum(event_id * 7919 % 10007) as key from obs group by 1)"""
_STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')"
_HEAT = """seg as (select l_orderkey % 7 as frame_id, l_partkey % 28 as class_idx, cast(l_partkey % 40 as double) as ax, cast(l_suppkey % 30 as double) as ay, cast(l_orderkey % 40 as double) as bx, cast(l_quantity % 30 as double) as by_ from lineitem),
  st as (select *, greatest(cast(trunc(greatest(abs(bx - ax), abs(by_ - ay))) as bigint), 1) as n from seg),
  pt as (select distinct frame_id, class_idx, cast(trunc(ax + (bx - ax) * k / n) as int) as x, cast(trunc(ay + (by_ - ay) * k / n) as int) as y from (select *, unnest(range(0, n + 1)) as k from st))"""

ORACLES = {
    "sequence_stream": f"{CTE} select printf('%d_%06d', video_id::bigint, frame_idx::bigint // 1500) as seq_name, frame_idx as frame, track_id, round(x1, 4) as x, round(y1, 4) as y, round(x2 - x1, 4) as w, round(y2 - y1, 4) as h from obs",
    "assignment_join": f"{CTE}, {STATS_SQL} select o.video_id, frame_idx, coalesce(role, 'unknown') as role, count(*) as players from obs o left join (select * from roles where track_id % 5 <> 0) r on r.video_id = o.video_id and r.track_id = o.track_id group by 1, 2, 3",
    "asof_homography": f"{CTE} select event_id, h.h02 + 0.0 as h02, o.frame_idx - h.frame_idx as age from obs o asof left join hom h on o.video_id = h.video_id and o.frame_idx >= h.frame_idx",
    "rolling_calibration": f"{CTE}, {_REFS}, {_FITS} select seq, {', '.join(f'case when n >= 50 then round({c}, 4) end as {c}' for c in _FIT_NAMES)} from fits",
    "asof_calibration": f"""{CTE}, {_REFS}, {_FITS}, ok as (select video_id, seq, {', '.join(_FIT_NAMES)} from fits where n >= 50)
        select r.seq, round(case when pitch_x is not null then pitch_x else greatest(-52.5, least(52.5, slope_x * u + intercept_x)) end + 1e-7, 4) as est_x,
               round(case when pitch_x is not null then pitch_y else greatest(-34.0, least(34.0, slope_y * v + intercept_y)) end + 1e-7, 4) as est_y
        from refs r asof left join ok k on r.video_id = k.video_id and r.seq >= k.seq""".replace("greatest(-52.5, least(52.5, slope_x * u + intercept_x))", "case when slope_x is not null then greatest(-52.5, least(52.5, slope_x * u + intercept_x)) end").replace("greatest(-34.0, least(34.0, slope_y * v + intercept_y))", "case when slope_y is not null then greatest(-34.0, least(34.0, slope_y * v + intercept_y)) end"),
    "outlier_flags": f"{CTE}, {_POINTS}, {_OUT.format(source='pts')} select video_id, track_id, count(*) as points, cast(sum(bad::int) as bigint) as outliers from flag group by 1, 2",
    "gap_fill": f"{CTE}, {_POINTS}, {_fill('pts', 'dense')} select {_END} from dense",
    "gaussian_smooth": f"{CTE}, {_POINTS}, {_fill('pts', 'dense')}, {_smooth('dense', 'g', 7.0)} select {_END} from g",
    "velocity_clamp": f"{CTE}, {_POINTS}, {_fill('pts', 'dense')}, {_clamp('dense', 'ahead', False)}, {_clamp('ahead', 'back', True)} select {_END} from back",
    "smooth_full": f"{CTE}, {_SMOOTH} select {_END} from h",
    "slot_velocity": f"{CTE}, {_VELOCITY} select {_KEYS}, round(vx + 1.37e-9, 6) + 0.0 as vx, round(vy + 1.37e-9, 6) + 0.0 as vy from vel",
    "trails": f"""{CTE}, t as (select event_id, count(*) over w as points, first_value(pitch_x) over w as ox from obs where pitch_x is not null window w as (partition by video_id, track_id order by frame_idx rows between 19 preceding and current row))
        select event_id, points, round(ox, 6) + 0.0 as oldest_x, cast(trunc(100 + 155 * (1.0e0 / points)) as int) as oldest_gray, 255 as newest_gray from t""",
    "heatmap_ema": f"""{CTE}, c as (select video_id, cast(floor((pitch_x + 60) / 40) as bigint) as cell, frame_idx, count(*) as x, from obs where pitch_x is not null group by 1, 2, 3),
        i as (select *, row_number() over (partition by video_id, cell order by frame_idx) as i from c)
        select a.video_id, a.cell, a.frame_idx, round(sum(0.1e0 * b.x * pow(0.9e0, a.i - b.i)), 6) + 0.0 as level from i a join i b on b.video_id = a.video_id and b.cell = a.cell and b.i <= a.i group by 1, 2, 3""",
    "colour_memo": f"{CTE} select event_id, coalesce(first_value(nullif(event_id * 7 % 11 % 4, 0) ignore nulls) over (partition by video_id, track_id order by frame_idx rows between unbounded preceding and current row), 0) as memo from obs".replace("first_value(nullif(event_id * 7 % 11 % 4, 0) ignore nulls)", "first_value(nullif(event_id * 7 % 11 % 4, 0) ignore nulls)"),
    "frame_iou_pairs": f"""{CTE}, p as (select a.video_id, a.frame_idx, a.track_id as track_a, b.track_id as track_b,
          greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i, (a.x2 - a.x1) * (a.y2 - a.y1) as sa, (b.x2 - b.x1) * (b.y2 - b.y1) as sb
          from obs a join obs b on b.video_id = a.video_id and b.frame_idx = a.frame_idx + 1)
        select video_id, frame_idx, track_a, track_b, round(i / (sa + sb - i + 0.000001e0), 6) as iou from p where i > 0""",
    "fragment_candidates": f"{CTE}, {_TRACKS} select video_id, child, parent, round(score, 6) + 0.0 as score from scored",
    "fragment_parents": f"{CTE}, {_TRACKS} select video_id, child, parent from par",
    "fragment_components": f"{CTE}, {_TRACKS} select video_id, track_id, root from comp",
    "slot_assignment": f"""{CTE}, {_TRACKS}, {_SLOTS} select s.video_id, slot_key, string_agg(cast(s.track_id as varchar), ',' order by s.track_id) as tracks, cast(sum(n) as bigint) as observations,
        arg_max(s.track_id, n * 1000000 - o) as main_track, bool_or(role = 'goalie') as is_goalie from slt s join rol r on r.video_id = s.video_id and r.track_id = s.track_id group by 1, 2""",
    "slot_frames": f"""{CTE}, {_TRACKS}, {_SLOTS}, pts as (select video_id, track_id, frame_idx, pitch_x as x, pitch_y as y from frag where pitch_x is not null), {_fill('pts', 'dense')},
        r as (select d.*, slot_key, o from dense d join slt using (video_id, track_id) join ord using (video_id, track_id)),
        e as (select video_id, slot_key, o, max(frame_idx) as f, arg_max(x, frame_idx) as x, arg_max(y, frame_idx) as y from r group by 1, 2, 3),
        b as (select video_id, slot_key, o, frame_idx, x, y from r union all select video_id, slot_key, o, unnest(range(f + 1, total)), x, y from e join (select video_id as lv, max(frame_idx) + 1 as total from frag group by 1) on lv = video_id)
        select video_id, slot_key, frame_idx, round(arg_max(x, o) + 1.37e-9, 6) + 0.0 as x, round(arg_max(y, o) + 1.37e-9, 6) + 0.0 as y from b group by 1, 2, 3""",
    "role_chain": f"{CTE}, {_CHAIN} select video_id, track_id, role, team, player_id from chain",
    "motion_plan": f"""{CTE}, {_VELOCITY}, p as (select *, cast(trunc(50 + (x + 52.5) * 10) as int) as px, cast(trunc(50 + (34 - y) * 10) as int) as py from vel),
        l as (select a.video_id, a.track_id, 'trail' as kind, a.px, a.py, a.i, n.i as n
              from p a join p n on n.video_id = a.video_id and n.track_id = a.track_id and n.i > a.i and n.i - a.i < 20 where abs(a.x) <= 57.5 and abs(a.y) <= 39),
        r as (select video_id, track_id, kind, px, py, cast(trunc(100 + 155 * ((i - n + least(20, n)) / cast(least(20, n) as double))) as int) as gray from l
              union all select video_id, track_id, 'arrow', px, py, null from p where (abs(vx) > 0.1 or abs(vy) > 0.1) and abs(x) <= 57.5 and abs(y) <= 39)
        select video_id, track_id, kind, count(*) as n, cast(sum(px) as bigint) as px, cast(sum(py) as bigint) as py, cast(sum(gray) as bigint) as gray from r group by 1, 2, 3""",
    "colour_vote": f"""{CTE}, {_VOTES}
        select video_id, track_id, case when b > a then 1 else 0 end as team, round(greatest(a, b) / (a + b), 5) as confidence, round(o, 5) as outlier_score, votes from vs""",
    "reid_similarity_topk": """with p as (select a.vec_id as query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: least(abs(z[1]), abs(z[2]))::double)), 6) as similarity
        from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
        select * from p qualify row_number() over (partition by query_id order by similarity desc, vec_id) <= 5""",
    "team_influence": f"{CTE}, {_INFLUENCE} select video_id, frame_idx, team, gx, gy, round(influence, 4) + 0.0 as influence from inf",
    "dominance_share": f"""{CTE}, {_INFLUENCE}, c as (select video_id, frame_idx, gx, gy, sum(case when team = 0 then influence else 0 end) as a, sum(case when team = 1 then influence else 0 end) as b from inf group by 1, 2, 3, 4)
        select video_id, frame_idx, round(avg(a / (a + b + 0.000001e0)), 4) as share_0, round(avg(b / (a + b + 0.000001e0)), 4) as share_1 from c group by 1, 2""",
    "line_heatmap": f"""with {_HEAT} select frame_id, class_idx, x + dx as px, y + dy as py, round(max(exp(-(dx * dx + dy * dy) / 18.0e0)), 6) + 0.0 as heat
        from pt, (select unnest(range(-6, 7))::int as dx), (select unnest(range(-6, 7))::int as dy) group by 1, 2, 3, 4""",
    "render_plan": f"""{CTE}, r as (select *, case when track_id % 3 = 0 then 'T0_' || track_id end as slot, cast(track_id % 4 - 1 as int) as team from obs where abs(pitch_x) <= 57.5 and abs(pitch_y) <= 39)
        select video_id, frame_idx, track_id, 'circle' as kind, cast(trunc(50 + (pitch_x + 52.5) * 10) as int) as px, cast(trunc(50 + (34 - pitch_y) * 10) as int) as py, case when team in (0, 1) then team else 2 end as colour,
          case when track_id % 7 = 0 then 'GK:' || coalesce(slot, '?' || track_id) when track_id % 11 = 0 then 'REF' else coalesce(slot, '?' || track_id) end as label from r""",
    "line_bbox": "select l_orderkey as frame_id, l_partkey % 28 as class_idx, round(min(l_discount::double * 10), 6) as xtl, round(min(l_tax::double * 12.5), 6) as ytl, round(max(l_discount::double * 10), 6) as xbr, round(max(l_tax::double * 12.5), 6) as ybr, count(*) as num_points from lineitem group by 1, 2",
    "line_keypoints": """with p as (select l_orderkey % 3000 as frame_id, l_partkey % 28 as class_idx, l_orderkey * 8 + l_linenumber as pos, l_discount::double * 10 as x, l_tax::double * 12.5 as y from lineitem),
        r as (select *, class_idx in (6, 7, 8) as circle from p),
        k as (select *, row_number() over (partition by frame_id, class_idx order by case when not circle then x end, case when not circle then y end, pos, x, y) - 1 as pt_idx from r)
        select frame_id, class_idx, pt_idx, round(x, 6) as x, round(y, 6) as y from k where pt_idx < case when circle then 12 else 2 end""",
    "dataset_merge_dedupe": f"with {_LABELS}, f as (select image, min(dataset * 2 + case when split = 'val' then 1 else 0 end) as p from lab group by 1) select lab.image, dataset, split, class_name, o_orderkey from lab join f on f.image = lab.image and dataset * 2 + case when split = 'val' then 1 else 0 end = p",
    "dataset_stats_rollup": f"with {_LABELS} select dataset, split, count(distinct image) as images, count(*) as annotations from lab group by rollup (dataset, split)",
    "class_distribution": f"with {_LABELS} select dataset, class_name, count(*) as annotations from lab group by 1, 2",
    "uncertainty_topk": f"{CTE}, {_PRED} select path, round(case when coalesce(len(boxes), 0) = 0 then 1.0e0 else 1 - list_sum(boxes) / len(boxes) end, 6) + 0.0 as uncertainty from pred order by 2 desc, 1 limit 25",
    "stratified_select": f"""{CTE}, {_PRED}, b as (select *, least(n_boxes // 5, 10) as bin from pred), r as (select *, row_number() over (partition by bin order by key, path) as k, greatest(1, 30 // (select count(distinct bin) from b)) as share from b)
        select path, cast(bin as int) as bin from r order by k > share, case when k <= share then bin end, key, path limit 30""",
    "hash_split": f"{CTE}, {_PRED} select path, case when (key % 1000) / 1000.0e0 < 0.8 then 'train' else 'val' end as split from pred",
    "exact_split": f"""{CTE}, {_PRED}, k as (select path, cast('0x' || substr(md5('42:' || path), 1, 15) as bigint) as key from pred)
        select path, case when row_number() over (order by key, path) <= floor((select count(*) from k) * 0.8e0) then 'train' else 'val' end as split from k""",
    "video_id": f"with p as (select doc_id, '/videos/' || source || '/Match Day ' || doc_id || ' Final Cut.mp4' as path from documents) select doc_id, substr(lower(replace({_STEM}, ' ', '_')), 1, 20) || '_' || substr(md5(path), 1, 8) as video_id from p",
    "output_path": f"with p as (select doc_id, '/videos/' || source || '.v1.mp4' as path from documents) select doc_id, 'analyzed_' || {_STEM} || case when doc_id % 2 = 0 then '_' || (doc_id % 90) || 's' else '' end || '_out.avi' as output from p",
}
