"""Per-track aggregates, roles and teams.

Every operator takes observations (video_id, track_id, frame_idx, x1..y2, pitch_x, pitch_y) and
groups by match and track: one shuffle with partial aggregation. Roles are expressions over the
one row of each track; what compares tracks of a match works on those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.geometry import r6
from touchline.functions.pitch import FPS

KEY = ["video_id", "track_id"]


def position_stats(obs: DataFrame, *more: Column) -> DataFrame:
    """mean, population deviation, least and most of pitch_x and pitch_y, and n; tracks with none are left out. more: further aggregates."""
    stats = [f(f"pitch_{a}").alias(f"{name}_{a}") for a in "xy" for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return obs.groupBy(KEY).agg(*stats, F.count("pitch_x").alias("n_samples"), *more).filter("n_samples > 0")


def durations(obs: DataFrame, fps: float = FPS) -> DataFrame:
    out = obs.groupBy(KEY).agg(F.count("*").alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
    return out.withColumn("seconds", r6(F.col("frames") / fps))


def long_tracks(obs: DataFrame, least: int = 30) -> DataFrame:
    """Observations of tracks with at least so many."""
    return obs.withColumn("_n", F.count("*").over(Window.partitionBy(KEY))).filter(F.col("_n") >= least).drop("_n")


def is_goalie() -> Column:
    return (F.abs("mean_x") > 36.0) & (F.col("std_x") < 10.0) & (F.col("n_samples") > 50)


def is_linesman() -> Column:
    return (F.abs("mean_y") > 32.0) & (F.col("std_y") < 5.0) & (F.col("n_samples") > 50)


def roles(stats: DataFrame) -> DataFrame:
    """stats with role; a goalkeeper is never a linesman."""
    return stats.withColumn("role", F.when(is_goalie(), "goalie").when(is_linesman(), "linesman").otherwise("player"))


def role_summary(assigned: DataFrame) -> DataFrame:
    """Tracks by role and by team, as one pass over grouping sets; needs role and team."""
    return assigned.groupingSets([[F.col("role")], [F.col("team")]], F.col("role"), F.col("team")).agg(F.count("*").alias("tracks"))


def goalie_teams(assigned: DataFrame) -> DataFrame:
    """Teams of goalkeepers by the side that their players stand on; team of others stays.

    assigned: video_id, track_id, role, team, mean_x.
    """
    plays = (F.col("role") == "player") & F.col("mean_x").isNotNull()
    sides = assigned.groupBy("video_id").agg(*(F.coalesce(F.avg(F.when(plays & (F.col("team") == t), F.col("mean_x"))), F.lit(0.0)).alias(f"avg_{t}") for t in (0, 1)))
    rows = assigned.join(sides, "video_id")
    left = F.when(F.col("avg_0") > F.col("avg_1"), 0).otherwise(1)
    right = F.when(F.col("avg_0") < F.col("avg_1"), 0).otherwise(1)
    team = F.when(F.col("role") == "goalie", F.when(F.col("mean_x") < 0, left).otherwise(right)).otherwise(F.col("team"))
    return rows.withColumn("team", team).drop("avg_0", "avg_1")


def pick_referee(candidates: DataFrame, least_spread: float = 2.0) -> DataFrame:
    """The outlier of each match: largest positive outlier_score within the touchlines that moves; first wins ties.

    candidates: video_id, track_id, outlier_score, mean_y, std_x, std_y, track_ordinal.
    """
    fit = (F.col("outlier_score") > 0) & (F.abs("mean_y") <= 30.0) & (F.col("std_x") + F.col("std_y") >= least_spread)
    best = F.max_by("track_id", F.struct(F.col("outlier_score"), -F.col("track_ordinal")))
    return candidates.filter(fit).groupBy("video_id").agg(best.alias("track_id"), F.max("outlier_score").alias("outlier_score"))


def assign_roles(obs: DataFrame, samples: DataFrame, model: dict | None, least: int = 30, least_spread: float = 2.0) -> DataFrame:
    """video_id, track_id, role, team, player_id of every track with so many observations and a position.

    A track is a goalkeeper, else a linesman, else the referee of its match, else a player. samples:
    video_id, track_id, colour; model: the colour mixture (mixture.fit on placed players), without
    which all are players of team 0. A track without samples is of team 0 and no referee. Linesmen and
    referees have team -1, goalkeepers the team whose players stand away from their goal and player_id 1.
    """
    first = F.min("frame_idx").alias("first_frame")
    order = Window.partitionBy("video_id").orderBy("first_frame", "track_id")
    placed = roles(position_stats(long_tracks(obs, least), first)).withColumn("track_ordinal", F.row_number().over(order))
    if model is None:
        voted = placed.withColumn("team", F.lit(0)).withColumn("outlier_score", F.lit(0.0))
    else:
        votes = colour_votes(samples.filter(F.col("colour").isNotNull()), model["means"], model["variances"], model["weights"])
        voted = placed.join(votes.select(*KEY, "team", "outlier_score"), KEY, "left").fillna({"team": 0, "outlier_score": 0.0})
    referee = pick_referee(voted.filter("role = 'player'"), least_spread).select("video_id", F.col("track_id").alias("_referee"))
    named = voted.join(referee, "video_id", "left").withColumn("role", F.when((F.col("role") == "player") & (F.col("track_id") == F.col("_referee")), "referee").otherwise(F.col("role")))
    sided = goalie_teams(named.withColumn("team", F.when(F.col("role").isin("linesman", "referee"), -1).otherwise(F.col("team"))))
    return sided.select(*KEY, "role", "team", F.when(F.col("role") == "goalie", 1).alias("player_id"))


def placed_players(obs: DataFrame, samples: DataFrame, least: int = 30) -> DataFrame:
    """The colour samples of tracks that are neither goalkeepers nor linesmen: what the colour mixture is fitted to."""
    players = roles(position_stats(long_tracks(obs, least))).filter("role = 'player'").select(*KEY)
    return samples.join(players, KEY, "left_semi")


def colour_votes(samples: DataFrame, means: list[list[float]], variances: list[list[float]], weights: list[float]) -> DataFrame:
    """Team of each track by summed posteriors of its colour samples (array colour) under two diagonal Gaussians."""

    def log_density(k: int) -> Column:
        total = F.lit(weights[k]).cast("double")
        total = F.ln(total)
        for d, (m, v) in enumerate(zip(means[k], variances[k], strict=True)):
            x = F.get("colour", F.lit(d)).cast("double")
            total = total - 0.5 * (F.ln(F.lit(2 * 3.141592653589793 * v)) + (x - m) * (x - m) / v)
        return total

    rows = samples.withColumn("_a", log_density(0)).withColumn("_b", log_density(1))
    rows = rows.withColumn("_p", 1.0 / (1.0 + F.exp(F.col("_b") - F.col("_a"))))
    rows = rows.withColumn("_team", F.when(F.col("_p") >= 0.5, 0).otherwise(1)).withColumn("_conf", F.greatest("_p", 1 - F.col("_p")))
    share = [F.sum(F.when(F.col("_team") == t, F.col("_conf")).otherwise(0.0)).alias(f"sum_{t}") for t in (0, 1)]
    out = rows.groupBy(KEY).agg(*share, F.avg(-F.ln(F.col("_conf") + 1e-10)).alias("outlier_score"), F.count("*").alias("votes"))
    out = out.withColumn("team", F.when(F.col("sum_1") > F.col("sum_0"), 1).otherwise(0))
    return out.withColumn("confidence", F.greatest("sum_0", "sum_1") / (F.col("sum_0") + F.col("sum_1")))
