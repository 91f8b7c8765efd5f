"""The whole analysis of matches, from boxes and homographies to the paths of slots.

Tables that several steps read are cut off by checkpoint(), so the session needs a checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import fragments, mixture, projection, tracking, tracks, trajectories

KEY = ["video_id", "track_id"]


def tracked(boxes: DataFrame) -> DataFrame:
    """boxes with track_id: as given, else by the box tracker over video_id, frame_idx, det_id; its repeated boxes are left out."""
    if "track_id" in boxes.columns:
        return boxes
    made = tracking.track_boxes(boxes).filter("det_id is not null").select("video_id", "frame_idx", "det_id", F.col("track").alias("track_id"))
    return boxes.join(made, ["video_id", "frame_idx", "det_id"])


def cast_of(obs: DataFrame, samples: DataFrame | None, model: dict | None, least_spread: float = 2.0) -> DataFrame:
    """A row for each track: its summary, role, team, player_id and root, the first of its fragments within the team."""
    samples = samples if samples is not None else obs.select(*KEY, F.lit(None).cast("array<double>").alias("colour")).limit(0)
    roles = tracks.assign_roles(obs, samples, model, least_spread=least_spread)
    cast = fragments.summaries(obs).join(roles, KEY).checkpoint()  # read many times
    teams = cast.filter(F.col("team").isin(0, 1))
    return cast.join(fragments.components(teams, fragments.parents(teams)).select(*KEY, "root"), KEY, "left").checkpoint()


def paths_of(obs: DataFrame, cast: DataFrame) -> DataFrame:
    """video_id, slot_key, frame_idx, x, y, vx, vy: the smoothed paths of the slots; a track that can't be smoothed is where it was seen.

    Paths are a track's own, so only those of tracks that have a slot are made: of a crowd that is a bounded number of slots.
    """
    slots = fragments.slots(cast).checkpoint()  # read for the observations and the paths
    obs = obs.join(slots.select(*KEY), KEY, "left_semi")
    smooth = trajectories.smooth_tracks(obs).checkpoint()  # read for the paths and for the tracks that have none
    seen = obs.filter("pitch_x is not null").join(smooth.select(*KEY).distinct(), KEY, "left_anti")
    frames = fragments.slot_frames(smooth.unionByName(trajectories.fill_gaps(seen)), slots, cast)
    moving = trajectories.velocities(frames.withColumnRenamed("slot_key", "track_id"))
    return moving.select("video_id", F.col("track_id").alias("slot_key"), "frame_idx", "x", "y", "vx", "vy")


def analyse(boxes: DataFrame, tries: DataFrame, samples: DataFrame | None = None, interval: int = 1, frames: int | None = None, components: int = 6) -> dict[str, DataFrame]:
    """placed (boxes with tracks and places), cast (a row for each track) and paths (of the slots) of all matches.

    boxes: video_id, frame_idx, x1..y2 and track_id, or det_id where tracks are to be found. tries: video_id, frame_idx,
    h00..h22, of which every interval-th frame is used. samples: video_id, track_id, colour, to which a mixture is
    fitted; without them, or with too few of placed players, all players are of team 0. frames: how many
    of each match are analysed, all by default.
    """
    if frames is not None:
        boxes, tries = boxes.filter(F.col("frame_idx") < frames), tries.filter(F.col("frame_idx") < frames)
    placed = projection.project_tracks(tracked(boxes), tries, interval=interval).checkpoint()
    model = mixture.fit(tracks.placed_players(placed, samples), components) if samples is not None else None
    cast = cast_of(placed, samples, model)
    return {"placed": placed, "cast": cast, "paths": paths_of(placed, cast)}
