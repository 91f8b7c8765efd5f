"""Velocities and trails as a streaming operator: a state for each share of a match's tracks or slots, frames in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.functions.pitch import FPS, VELOCITY_CAP
from touchline.operators.matching import _runs
from touchline.operators.trajectories import KEY

MOTION = "frame_idx bigint, x double, y double, vx double, vy double, trail_x array<double>, trail_y array<double>, points bigint, oldest_gray int, newest_gray int"
STATE = "tracks binary"
#: Groups that the tracks of a match are dealt to; the tracks of a group are worked out together, a frame of all of them at a time.
SHARES = 128


def _dumps(names: pd.Index, last: np.ndarray, vx: np.ndarray, vy: np.ndarray, size: np.ndarray, px: np.ndarray, py: np.ndarray) -> bytes:
    """The tracks of a group as an Arrow stream."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    trails = [pa.ListArray.from_arrays(offsets, pa.array(p)) for p in (px, py)]
    table = pa.table({"track_id": pa.array(names), "last": last, "vx": vx, "vy": vy, "places": size, "trail_x": trails[0], "trail_y": trails[1]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _loads(tracks: bytes) -> pa.Table:
    return pa.ipc.open_stream(tracks).read_all()


def motion_stream(points: DataFrame, fps: float = FPS, keep: float = 0.7, most: float = VELOCITY_CAP, length: int = 60, forget: int | None = None) -> DataFrame:
    """trajectories.velocities and trails over a stream of video_id, track_id (of any type), frame_idx, x, y.

    Every point comes out with its velocity, oldest first the last places of its track (at most length), and the greys of
    the oldest and the newest. The state of a track is a velocity and those places, whatever the length of the match. A micro-batch is
    sorted by frame within a track; frames at or before the last one seen are late and left out, as are points without a
    place; of points that share a frame one is taken, the least by x and y. A track not seen for more than forget frames
    starts anew at its next point; with None, as in the batch operators, its last place counts whatever its age.
    """
    kinds = {c: points.schema[c].dataType.simpleString() for c in KEY}
    schema = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", " + MOTION

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[["track_id", "frame_idx", "x", "y"]] for b in batches], ignore_index=True).dropna(subset=["frame_idx", "x", "y"])
        held = _loads(state.get[0]) if state.exists else None
        known = rows["track_id"].iloc[:0] if held is None else held["track_id"].to_pandas()
        codes, names = pd.factorize(pd.concat([known, rows["track_id"]], ignore_index=True), use_na_sentinel=False)
        track, n, old = codes[len(known) :], len(names), len(known)
        last, vx, vy, had = np.full(n, np.iinfo(np.int64).min), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        if old:
            last[:old], vx[:old], vy[:old], had[:old] = (held[c].to_numpy() for c in ("last", "vx", "vy", "places"))
        frame, x, y = rows["frame_idx"].to_numpy(np.int64), rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        order = np.lexsort((y, x, frame, track))
        order = order[frame[order] > last[track[order]]]
        order = order[(np.diff(track[order], prepend=-1) != 0) | (np.diff(frame[order], prepend=0) != 0)]
        track, frame, x, y = track[order], frame[order], x[order], y[order]
        many = np.bincount(track, minlength=n)
        heads = np.cumsum(many) - many
        # all places in a row, those of the state before the new ones of each track
        base = np.cumsum(had + many) - had - many
        place = base[track] + had[track] + np.arange(len(track)) - heads[track]
        px, py = np.zeros(int((had + many).sum())), np.zeros(int((had + many).sum()))
        if old:
            before = _runs(base, had)
            px[before], py[before] = (held[c].combine_chunks().values.to_numpy() for c in ("trail_x", "trail_y"))
        px[place], py[place] = x, y
        ahead = np.empty_like(frame)  # the frame before of the same track
        ahead[1:] = frame[:-1]
        first = heads[many > 0]
        ahead[first] = last[track[first]]
        anew = np.zeros(len(track), dtype=bool)
        if forget is not None:
            anew = (ahead != np.iinfo(np.int64).min) & (frame - np.maximum(ahead, frame - forget - 1) > forget)
        begin = np.maximum(np.maximum.accumulate(np.where(anew, place, base[track])), place - length + 1)
        points_held, speeds_x, speeds_y = place - begin + 1, np.zeros(len(track)), np.zeros(len(track))
        for k in range(int(many.max(initial=0))):  # a point of every track at a time
            at = heads[many > k] + k
            who, here = track[at], place[at]
            cx, cy = np.where(anew[at], 0.0, vx[who]), np.where(anew[at], 0.0, vy[who])
            moved = points_held[at] > 1 if length > 1 else (here > base[who]) & ~anew[at]
            back = np.maximum(here - 1, 0)
            cx = np.where(moved, keep * cx + (1 - keep) * ((px[here] - px[back]) * fps), cx)
            cy = np.where(moved, keep * cy + (1 - keep) * ((py[here] - py[back]) * fps), cy)
            speed = np.sqrt(cx * cx + cy * cy)
            over = moved & (speed > most)
            share = np.where(over, most / np.where(over, speed, 1.0), 1.0)
            cx, cy = cx * share, cy * share
            vx[who], vy[who], speeds_x[at], speeds_y[at] = cx, cy, cx, cy
        ends = heads[many > 0] + many[many > 0] - 1
        last[track[ends]] = frame[ends]
        size = had.copy()
        size[track[ends]] = points_held[ends]
        kept = _runs(base + had + many - size, size)
        if len(track):
            state.update((_dumps(names, last, vx, vy, size, px[kept], py[kept]),))
        made = {"video_id": [key[0]] * len(track), "track_id": names.take(track), "frame_idx": frame, "x": x, "y": y, "vx": speeds_x, "vy": speeds_y}
        made |= {c: pd.Series([values[i:j] for i, j in zip(begin.tolist(), (place + 1).tolist(), strict=True)], dtype=object) for c, values in (("trail_x", px), ("trail_y", py))}
        yield pd.DataFrame(made | {"points": points_held, "oldest_gray": (100 + 155 / points_held).astype(np.int32), "newest_gray": np.full(len(track), 255, np.int32)})

    share = F.when(F.col("track_id").isNotNull(), F.pmod(F.xxhash64("track_id"), F.lit(SHARES))).otherwise(-1)
    rows = points.select(*KEY, "frame_idx", "x", "y").withColumn("_share", share)
    return rows.groupBy("video_id", "_share").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)
