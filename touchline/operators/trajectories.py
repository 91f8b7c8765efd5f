"""As-of lookups, calibration, outliers, gaps, smoothing and speed limits of trajectories.

What a window can say is a window over (match, track) or over a match in frame order. Steps whose
input is their own last output (speed limits, feedback averages) run as one Arrow kernel for each
track, so a task holds a track at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.functions.pitch import FPS, MAX_SPEED, OUTLIER_SPEED, VELOCITY_CAP

KEY = ["video_id", "track_id"]
#: Frames of a match that one task fills forward.
BLOCK_FRAMES = 9000


def by_frame() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("frame_idx")


def asof_homography(obs: DataFrame, homographies: DataFrame) -> DataFrame:
    """Observations with the entries of the latest homography of their match, and its age in frames.

    The homographies are stacked with the frames there are, a row for each, and filled forward in frame order, in one shuffle
    by match and block of frames: a block of BLOCK_FRAMES starts with the last homography before it. Observations
    meet their frame's in an equi-join, so a crowded match is not one task.
    """
    entries = [c for c in homographies.columns if c.startswith("h")]
    packed = homographies.select("video_id", "frame_idx", F.struct(F.col("frame_idx").alias("at"), *entries).alias("_h"))
    block = lambda df: df.withColumn("_block", F.floor(F.col("frame_idx") / BLOCK_FRAMES))
    last = block(packed).groupBy("video_id", "_block").agg(F.max("_h").alias("_h"))
    frames = obs.select("video_id", "frame_idx").distinct()
    # a row per block and match: the last homography of the blocks before it
    blocks = block(frames).select("video_id", "_block").distinct().withColumn("_h", F.lit(None).cast(last.schema["_h"].dataType))
    ahead = Window.partitionBy("video_id").orderBy("_block", F.col("_h").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(blocks).withColumn("_h", F.last("_h", ignorenulls=True).over(ahead)).dropDuplicates(["video_id", "_block"])
    stacked = block(frames.withColumn("_h", F.lit(None).cast(last.schema["_h"].dataType)).withColumn("_kind", F.lit(2)))
    stacked = stacked.unionByName(block(packed.withColumn("_kind", F.lit(1))))
    stacked = stacked.unionByName(carried.withColumn("_kind", F.lit(0)).withColumn("frame_idx", F.col("_block") * BLOCK_FRAMES).select(*stacked.columns))
    order = Window.partitionBy("video_id", "_block").orderBy("frame_idx", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = stacked.withColumn("_h", F.last("_h", ignorenulls=True).over(order)).filter("_kind = 2").select("video_id", "frame_idx", "_h")
    made = [F.col(f"_h.{e}").alias(e) for e in entries]
    return obs.join(filled, ["video_id", "frame_idx"], "left").select(*obs.columns, *made, (F.col("frame_idx") - F.col("_h.at")).alias("age"))


def _numbered(rows: DataFrame, order: list[str], place: Column, block: int | None = None) -> DataFrame:
    """rows with _n, their number in their match by order; place: a whole number that rises with order, block (BLOCK_FRAMES) of which one task counts."""
    blocked = rows.withColumn("_k", F.floor(place / (block or BLOCK_FRAMES)))
    ahead = Window.partitionBy("video_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sizes = blocked.groupBy("video_id", "_k").agg(F.count("*").alias("_c")).withColumn("_c", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("video_id", "_k").orderBy(*order))
    return blocked.join(sizes, ["video_id", "_k"]).withColumn("_n", within + F.col("_c")).drop("_k", "_c")


def carried(rows: DataFrame, value: str, order: list[str], place: Column, block: int | None = None) -> DataFrame:
    """rows with their NULLs in value filled by the last value before them in their match, in blocks as _numbered."""
    blocked = rows.withColumn("_k", F.floor(place / (block or BLOCK_FRAMES)))
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    last = blocked.groupBy("video_id", "_k").agg(F.max_by(value, known).alias("_last"))
    ahead = Window.partitionBy("video_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    last = last.withColumn("_last", F.last("_last", ignorenulls=True).over(ahead))
    upto = Window.partitionBy("video_id", "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(upto), "_last")
    return blocked.join(last, ["video_id", "_k"]).withColumn(value, filled).drop("_k", "_last")


def rolling_calibration(refs: DataFrame, least: int = 50, rows: int = 200, block: int = BLOCK_FRAMES) -> DataFrame:
    """refs with slope and intercept of pitch_x on u and of pitch_y on v, over the last rows references of the match.

    refs: video_id, seq (order), u, v, pitch_x, pitch_y, none of them NULL. NULL before the least-th
    reference and where u or v do not vary. Sums over the last rows are differences of running sums,
    so a reference costs the same however many rows there are. They run in blocks of block references
    (at least rows), each begun with the rows - 1 references before it: a match is not one task. References
    that have a column _n are numbered by it, others by seq, a whole number.
    """
    made = [f"{f}_{a}" for a in "xy" for f in ("slope", "intercept")]
    block = max(block, rows)
    home = F.floor((F.col("_n") - 1) / block)
    numbered = refs if "_n" in refs.columns else _numbered(refs, ["seq"], F.col("seq"))
    needed = (F.col("_n") - 1) % block > block - rows
    blocked = numbered.withColumn("_b", F.explode(F.when(needed, F.array(home, home + 1)).otherwise(F.array(home))))
    order = Window.partitionBy("video_id", "_b").orderBy("_n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    terms = {}
    for a, b in (("x", "u"), ("y", "v")):
        p, q = F.col(f"pitch_{a}"), F.col(b)
        terms |= {f"_{b}": q, f"_{a}": p, f"_{b}{b}": q * q, f"_{b}{a}": q * p}
        # the last place where b changed, which says whether it varies among the last rows
        terms[f"_at_{b}"] = F.when(q != F.lag(q).over(order), F.col("_n"))
    sums = {k: (F.max if k.startswith("_at_") else F.sum)(F.col(f"{k}_t")).over(upto) for k in terms}
    running = blocked.withColumns({f"{k}_t": v for k, v in terms.items()}).withColumns(sums)
    ended = {k: F.col(k) - F.coalesce(F.lag(k, rows).over(order), F.lit(0.0)) for k in terms if not k.startswith("_at_")}
    last = running.withColumns(ended).filter(F.col("_b") == home)
    n = F.least(F.col("_n"), F.lit(rows))
    fits = {}
    for a, b in (("x", "u"), ("y", "v")):
        varies = F.col(f"_at_{b}") > F.col("_n") - n + 1
        slope = (n * F.col(f"_{b}{a}") - F.col(f"_{b}") * F.col(f"_{a}")) / (n * F.col(f"_{b}{b}") - F.col(f"_{b}") * F.col(f"_{b}"))
        fits[f"slope_{a}"] = F.when((F.col("_n") >= least) & varies, slope)
        fits[f"intercept_{a}"] = (F.col(f"_{a}") - fits[f"slope_{a}"] * F.col(f"_{b}")) / n
    return last.withColumns(fits).select(*(c for c in refs.columns if c != "_n"), *made)


def calibrated_positions(rows: DataFrame, least: int = 50, last: int = 200) -> DataFrame:
    """rows with est_x, est_y: their own position, else that of the latest calibration of the match, clamped to the pitch."""
    known = F.col("pitch_x").isNotNull()
    fits = rolling_calibration(rows.filter(known), least, last)
    made = ["slope_x", "intercept_x", "slope_y", "intercept_y"]
    both = fits.unionByName(rows.filter(~known), allowMissingColumns=True)
    both = both.withColumn("_fit", F.when(F.col("slope_x").isNotNull() & F.col("slope_y").isNotNull(), F.struct(*made)))
    both = carried(both, "_fit", ["seq"], F.col("seq")).withColumns({c: F.col(f"_fit.{c}") for c in made}).drop("_fit")
    guess = lambda a, b, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.col(f"slope_{a}") * F.col(b) + F.col(f"intercept_{a}")))
    x = F.when(known, F.col("pitch_x")).when(F.col("slope_x").isNotNull(), guess("x", "u", 52.5))
    y = F.when(known, F.col("pitch_y")).when(F.col("slope_y").isNotNull(), guess("y", "v", 34.0))
    return both.withColumn("est_x", x).withColumn("est_y", y).drop(*made)


def _speed(near: Column, x: str = "pitch_x", y: str = "pitch_y") -> Column:
    dt = F.greatest(F.abs(F.col("frame_idx") - near["frame_idx"]), F.lit(1))
    dx, dy = F.col(x) - near[x], F.col(y) - near[y]
    return F.sqrt(dx * dx + dy * dy) / dt


def outliers(projected: DataFrame, limit: float = OUTLIER_SPEED, fps: float = FPS) -> DataFrame:
    """Projected observations with is_outlier: too fast from the one before and to the one after."""
    point = F.struct("frame_idx", "pitch_x", "pitch_y")
    both = projected.withColumns({"_p": F.lag(point).over(by_frame()), "_n": F.lead(point).over(by_frame())})
    far = lambda c: _speed(F.col(c)) > limit / fps
    return both.withColumn("is_outlier", F.coalesce(far("_p") & far("_n"), F.lit(False))).drop("_p", "_n")


def fill_gaps(points: DataFrame, x: str = "pitch_x", y: str = "pitch_y") -> DataFrame:
    """video_id, track_id, frame_idx, x, y on every frame between a track's first and last: linear between points."""
    ahead = points.withColumn("_n", F.lead(F.struct("frame_idx", x, y)).over(by_frame()))
    span = F.sequence("frame_idx", F.coalesce(F.col("_n.frame_idx") - 1, F.col("frame_idx")))
    dense = ahead.withColumn("_f", F.explode(span))
    part = (F.col("_f") - F.col("frame_idx")) / (F.col("_n.frame_idx") - F.col("frame_idx"))
    lerp = lambda c: F.when(F.col("_f") == F.col("frame_idx"), F.col(c)).otherwise(F.col(c) + part * (F.col(f"_n.{c}") - F.col(c)))
    return dense.select(*KEY, F.col("_f").alias("frame_idx"), lerp(x).alias("x"), lerp(y).alias("y"))


def gaussian_kernel(sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return weights / weights.sum()


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of columns; the ends are reflected, edge included."""
    kernel = gaussian_kernel(sigma)
    radius, n = len(kernel) // 2, len(values)
    fold = np.mod(np.arange(-radius, n + radius), 2 * n)
    padded = values[np.where(fold < n, fold, 2 * n - 1 - fold)]
    return np.stack([np.convolve(c, kernel, "valid") for c in padded.T], axis=1)


def limit_speed(points: np.ndarray, frames: np.ndarray, most: float) -> np.ndarray:
    """Shortens steps over most metres a frame, each from the point that the last step ended at."""
    out = points.copy()
    x, y = out[:1].ravel() if len(out) else (0.0, 0.0)
    for i in range(1, len(out)):
        dx, dy, reach = out[i, 0] - x, out[i, 1] - y, most * abs(int(frames[i]) - int(frames[i - 1]))
        length = (dx * dx + dy * dy) ** 0.5
        if length > reach:
            out[i] = x + dx * (reach / length), y + dy * (reach / length)
        x, y = out[i]
    return out


def _by_track(df: DataFrame, kernel, columns: str = "x double, y double") -> DataFrame:
    """Runs kernel(frames, points) on every track of video_id, track_id (of any type), frame_idx, x, y."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in KEY) + ", frame_idx bigint, " + columns
    names = [c.split()[0] for c in columns.split(",")]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        frames = rows["frame_idx"].to_numpy()
        made = kernel(frames, np.stack([rows["x"].to_numpy(), rows["y"].to_numpy()], axis=1))
        n = len(made)
        fixed = {c: pa.array([k.as_py()] * n, k.type) for c, k in zip(KEY, key, strict=True)} | {"frame_idx": pa.array(frames[:n], pa.int64())}
        return pa.table(fixed | {c: pa.array(made[:, k], pa.float64()) for k, c in enumerate(names)})

    return df.select(*KEY, "frame_idx", "x", "y").groupBy(*KEY).applyInArrow(run, schema)


def gaussian_smooth(dense: DataFrame, sigma: float = 7.0) -> DataFrame:
    return _by_track(dense, lambda frames, points: smooth(points, sigma))


def clamp_velocity(dense: DataFrame, most: float = MAX_SPEED, fps: float = FPS) -> DataFrame:
    """Forward and then backward speed limits."""

    def both(frames: np.ndarray, points: np.ndarray) -> np.ndarray:
        ahead = limit_speed(points, frames, most / fps)
        return limit_speed(ahead[::-1], frames[::-1], most / fps)[::-1]

    return _by_track(dense, both)


def smooth_tracks(obs: DataFrame, sigma: float = 7.0, most: float = MAX_SPEED, fps: float = FPS, least: int = 10, least_points: int = 5) -> DataFrame:
    """Outliers out, gaps filled, smoothed, limited both ways, smoothed with half sigma; tracks too short are left out."""
    whole = Window.partitionBy(*KEY)
    rows = obs.withColumn("_n", F.count("*").over(whole)).withColumn("_p", F.count("pitch_x").over(whole))
    points = outliers(rows.filter((F.col("_n") >= least) & (F.col("_p") >= least_points) & F.col("pitch_x").isNotNull())).filter("not is_outlier")
    points = points.withColumn("_p", F.count("*").over(whole)).filter(F.col("_p") >= least_points)

    def steps(frames: np.ndarray, p: np.ndarray) -> np.ndarray:
        p = limit_speed(smooth(p, sigma), frames, most / fps)
        p = limit_speed(p[::-1], frames[::-1], most / fps)[::-1]
        return smooth(p, sigma / 2)

    return _by_track(fill_gaps(points), steps)


def velocities(dense: DataFrame, fps: float = FPS, keep: float = 0.7, most: float = VELOCITY_CAP) -> DataFrame:
    """vx, vy: averaged with the last one, then cut to most m/s, and that is what the next one averages with."""

    def feedback(frames: np.ndarray, points: np.ndarray) -> np.ndarray:
        raw = np.zeros_like(points)
        raw[1:] = (points[1:] - points[:-1]) * fps
        out, vx, vy = np.zeros_like(points), 0.0, 0.0
        for i, (rx, ry) in enumerate(raw.tolist()):
            vx, vy = (rx, ry) if i == 0 else (keep * vx + (1 - keep) * rx, keep * vy + (1 - keep) * ry)
            speed = (vx * vx + vy * vy) ** 0.5
            if speed > most:
                vx, vy = vx * (most / speed), vy * (most / speed)
            out[i] = vx, vy
        return np.concatenate([points, out], axis=1)

    return _by_track(dense, feedback, "x double, y double, vx double, vy double")


def trails(points: DataFrame, length: int = 60) -> DataFrame:
    """The last positions of each track, with how many and the grey of the newest and the oldest."""
    last = by_frame().rowsBetween(1 - length, 0)
    n = F.count("*").over(last)
    gray = lambda k: (F.lit(100) + 155 * (k / n)).cast("int")
    return points.withColumns({"trail": F.collect_list(F.struct("pitch_x", "pitch_y")).over(last), "points": n, "oldest_gray": gray(F.lit(1)), "newest_gray": gray(n)})


def heat_average(cells: DataFrame, keep: float = 0.9) -> DataFrame:
    """level * keep + x * (1 - keep) in frame order for each (video_id, cell) of x; frames are those given."""
    schema = "video_id bigint, cell bigint, frame_idx bigint, level double"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        level, out = 0.0, []
        for x in rows["x"].to_pylist():
            level = keep * level + (1 - keep) * x
            out.append(level)
        return pa.table({"video_id": rows["video_id"], "cell": rows["cell"], "frame_idx": rows["frame_idx"], "level": pa.array(out, pa.float64())})

    return cells.select("video_id", "cell", "frame_idx", "x").groupBy("video_id", "cell").applyInArrow(run, schema)


def colour_memo(rows: DataFrame, colour: str = "colour") -> DataFrame:
    """The first colour other than 0 that a track showed up to a frame; 0 before."""
    first = F.first(F.nullif(F.col(colour), F.lit(0)), ignorenulls=True).over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("memo", F.coalesce(first, F.lit(0)))
