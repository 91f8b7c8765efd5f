"""Space control: team influence on a grid, shares, and the drawing plan.

Cells are enumerated from each player (two sequences, no join), so the rows are players times a
constant number of cells, and partial sums leave a row per frame, team and cell before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.pitch import HALF_LENGTH, HALF_WIDTH


def influence(players: DataFrame, cell: float = 5.0) -> DataFrame:
    """video_id, frame_idx, team, gx, gy, influence at the centres of a grid over the pitch.

    players: video_id, frame_idx, team, x, y, vx, vy. Each is an oriented Gaussian ahead of where it runs.
    """
    n_x, n_y = int(2 * HALF_LENGTH / cell), int(2 * HALF_WIDTH / cell)
    s = F.least(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), F.lit(8.0))
    rows = players.withColumns({"_s": s, "_a": F.atan2("vy", "vx"), "_mx": F.col("x") + 0.5 * F.col("vx"), "_my": F.col("y") + 0.5 * F.col("vy")})
    rows = rows.withColumn("_sx", 4 + 0.5 * F.col("_s")).withColumn("_sy", 4 / (1 + 0.1 * F.col("_s")))
    rows = rows.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(n_y - 1))))
    dx, dy = (F.col("gx") + 0.5) * cell - HALF_LENGTH - F.col("_mx"), (F.col("gy") + 0.5) * cell - HALF_WIDTH - F.col("_my")
    along, across = dx * F.cos("_a") + dy * F.sin("_a"), dy * F.cos("_a") - dx * F.sin("_a")
    level = F.exp(-(along * along / (2 * F.col("_sx") * F.col("_sx")) + across * across / (2 * F.col("_sy") * F.col("_sy"))))
    return rows.groupBy("video_id", "frame_idx", "team", "gx", "gy").agg(F.sum(level).alias("influence"))


def _grid(columns: int, rows: int, scale: float, margin: float, pixels: float) -> tuple[np.ndarray, np.ndarray]:
    """Pitch x of the drawn grid's columns and pitch y of its rows."""
    return (np.arange(columns) * scale - margin) / pixels - HALF_LENGTH, HALF_WIDTH - (np.arange(rows) * scale - margin) / pixels


#: Metres that the players' levels are carried over by products before they are exponentials again; places in a step.
STRIDE, PLACES = 16.4, 16384
#: Players of a team up to which frames are taken together.
FEW = 512
#: Sums below it are made again cell by cell: products may have run dry on the way to them.
THIN = 1e-200


def _shape(places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Centre, direction and the factors of the squares along and across of players (x, y, vx, vy)."""
    x, y, vx, vy = places.T
    speed, turn = np.minimum(np.hypot(vx, vy), 8.0), np.arctan2(vy, vx)
    return x + 0.5 * vx, y + 0.5 * vy, np.cos(turn), np.sin(turn), 0.5 / (4 + 0.5 * speed) ** 2, 0.5 * ((1 + 0.1 * speed) / 4) ** 2


def _levels(places: np.ndarray, kind: np.ndarray, kinds: int, across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The influence of players (x, y, vx, vy) in every cell, summed by kind: kinds x rows x columns.

    The exponent is a polynomial of the second degree along a row of evenly spaced cells, so from column to column a
    level changes by a ratio and the ratio by a constant: two products a cell, and an exponential every STRIDE metres.
    What is too small for a number there is under THIN for as long.
    """
    out = np.zeros((len(across), len(down), kinds))
    step = (across[-1] - across[0]) / max(len(across) - 1, 1)
    size, stride = max(1, PLACES // len(down)), max(1, int(STRIDE / max(step, STRIDE / 41) + 1e-9))
    for at in range(0, len(places), size):
        x, y, cos, sin, ahead, aside = _shape(places[at : at + size])
        sort = np.eye(kinds)[kind[at : at + size]]
        a, b = cos * cos * ahead + sin * sin * aside, 2 * cos * sin * (ahead - aside)
        dy = down[:, None] - y
        # bounds that only players whose levels are 0 everywhere pass
        slope, bend = np.exp(np.clip(-step * b * dy, -100, 100)), np.broadcast_to(np.exp(-2 * a * step * step), dy.shape).copy()
        for begin in range(0, len(across), stride):
            dx = across[begin] - x
            level = np.exp(-(ahead * (dx * cos + dy * sin) ** 2 + aside * (dy * cos - dx * sin) ** 2))
            ratio = np.exp(np.clip(-a * step * (2 * dx + step), -600, 600)) * slope
            for k in range(begin, min(begin + stride, len(across))):
                out[k] += level @ sort
                level *= ratio
                ratio *= bend
    out = out.transpose(2, 1, 0)
    for team in np.unique(kind):
        rows, columns = np.nonzero(out[team] < THIN)
        some = [v[:, None] for v in _shape(places[kind == team])]
        for at in range(0, len(rows), size := max(1, PLACES // len(some[0]))):
            i, j = rows[at : at + size], columns[at : at + size]
            x, y, cos, sin, ahead, aside = some
            dx, dy = across[j] - x, down[i] - y
            out[team, i, j] = np.exp(-(ahead * (dx * cos + dy * sin) ** 2 + aside * (dy * cos - dx * sin) ** 2)).sum(axis=0)
    return out


def _rosters(players: DataFrame) -> DataFrame:
    """video_id, frame_idx, first (players of team 0), places (x, y, vx, vy of them and then of team 1, as bytes) of every frame."""
    place = F.struct("team", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "vx", "vy")))
    frames = players.filter(F.col("team").isin(0, 1)).groupBy("video_id", "frame_idx").agg(F.collect_list(place).alias("p"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, places = [], []
            for roster in batch.column("p"):
                flat = roster.values
                cells = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "vx", "vy")], axis=1)
                team = flat.field("team").to_numpy(zero_copy_only=False)
                first.append(int((team == 0).sum()))
                places.append(cells[np.argsort(team, kind="stable")].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), pa.array(first, pa.int64()), pa.array(places, pa.binary())], names=["video_id", "frame_idx", "first", "places"])

    keys = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("video_id", "frame_idx"))
    return frames.mapInArrow(pack, f"{keys}, first bigint, places binary")


def _maps(rosters: Iterator[tuple[object, int, bytes]], across: np.ndarray, down: np.ndarray, most: int) -> Iterator[tuple[object, np.ndarray]]:
    """(key, the maps of both teams) of rosters (key, first, places), of at most so many small ones at once."""

    def made(held: list[tuple[object, int, np.ndarray]]) -> Iterator[tuple[object, np.ndarray]]:
        kind = np.concatenate([2 * k + (np.arange(len(places)) >= first) for k, (_, first, places) in enumerate(held)]) if held else []
        levels = _levels(np.concatenate([places for _, _, places in held]), kind, 2 * len(held), across, down) if held else []
        yield from ((key, levels[2 * k : 2 * k + 2]) for k, (key, _, _) in enumerate(held))

    held: list[tuple[object, int, np.ndarray]] = []
    for key, first, raw in rosters:
        places = np.frombuffer(raw).reshape(-1, 4)
        if held and (len(held) >= most or sum(len(h[2]) for h in held) + len(places) > 2 * FEW):
            yield from made(held)
            held = []
        if len(places) > 2 * FEW:  # a team at a time
            yield key, np.concatenate([_levels(part, np.zeros(len(part), np.int64), 1, across, down) for part in (places[:first], places[first:])])
        else:
            held.append((key, first, places))
    yield from made(held)


#: Bands of rows that the frames of a match are dealt to.
BANDS = 13


def averaged_dominance(players: DataFrame, keep: float = 0.9, chunk: int = 8, columns: int = 287, rows: int = 195, scale: float = 4.0, margin: float = 50.0, pixels: float = 10.0) -> DataFrame:
    """video_id, frame_idx, share_0, share_1, cells_0 of the teams' averaged influence, over the cells on the pitch.

    A frame's map of a team counts 1 - keep in the average, the last average keep; a match's first map is its first average.
    Shares are taken of the averages; cells off the pitch count for neither team. Frames without a player
    of either team are passed over.

    The average of a cell needs that cell alone, so a match is dealt into BANDS bands of rows: a task goes through a band's
    frames in order, with its average and at most chunk maps, each made once; a frame's shares are sums over its bands.
    players: as for influence.
    """
    across, down = _grid(columns, rows, scale, margin, pixels)
    inside = (np.abs(down) <= HALF_WIDTH)[:, None] & (np.abs(across) <= HALF_LENGTH)[None, :]
    bands = [b for b in np.array_split(np.arange(rows), min(BANDS, rows)) if inside[b].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, average, out = None, None, []

        def rosters() -> Iterator[tuple[tuple, int, bytes]]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield (row["video_id"], row["band"], row["frame_idx"]), row["first"], row["places"]

        def share(part: Iterator[tuple[tuple, int, bytes]], band: int) -> Iterator[tuple]:
            nonlocal match, average
            on = inside[bands[band]]
            for key, made in _maps(part, across, down[bands[band]], chunk):
                average = made if match != key[:2] else keep * average + (1 - keep) * made
                match = key[:2]
                parts = np.where(on, average / (average.sum(axis=0) + 1e-6), 0.0).sum(axis=(1, 2)) / inside.sum()
                yield key[0], key[2], float(parts[0]), float(parts[1]), int((on & (average[0] > average[1])).sum())

        for (_, band), part in groupby(rosters(), key=lambda r: r[0][:2]):
            for row in share((r for r in part), band):
                out.append(row)
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["video_id", "frame_idx", "share_0", "share_1", "cells_0"])

    frames = _rosters(players).select(*(F.col(c).cast("long").alias(c) for c in ("video_id", "frame_idx")), "first", "places")
    dealt = frames.withColumn("band", F.explode(F.array(*map(F.lit, range(len(bands)))))).repartition(_tasks(players), "video_id", "band").sortWithinPartitions("video_id", "band", "frame_idx")
    shares = dealt.mapInArrow(run, "video_id bigint, frame_idx bigint, share_0 double, share_1 double, cells_0 bigint")
    return shares.groupBy("video_id", "frame_idx").agg(*(F.sum(c).alias(c) for c in ("share_0", "share_1", "cells_0")))


def _tasks(rows: DataFrame) -> int:
    """A number of tasks that evens out what is long to compute and short to read: AQE would put it together by its size."""
    return 8 * rows.sparkSession.sparkContext.defaultParallelism


def frame_dominance(players: DataFrame, columns: int = 287, rows: int = 195, scale: float = 4.0, margin: float = 50.0, pixels: float = 10.0) -> DataFrame:
    """video_id, frame_idx, share_0, share_1, cells_0: the mean shares of the teams and the cells that team 0 leads, over the drawn grid.

    players as for influence. The grid has a cell for every scale-th pixel of the drawn pitch, margins
    included: averaged_dominance leaves them out. A row gathers the players of one frame, a roster; the map of a frame
    never leaves its task.
    """
    across, down = _grid(columns, rows, scale, margin, pixels)
    frames = _rosters(players).repartition(_tasks(players), "video_id", "frame_idx")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for _, (a, b) in _maps(zip(range(len(batch)), batch.column("first").to_pylist(), batch.column("places").to_pylist(), strict=True), across, down, 1):
                total = a + b + 1e-6
                shares.append((float((a / total).mean()), float((b / total).mean()), int((a > b).sum())))
            made = [pa.array(list(c), t) for c, t in zip(zip(*shares, strict=True), (pa.float64(), pa.float64(), pa.int64()), strict=True)] if shares else [pa.array([], t) for t in (pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), *made], names=["video_id", "frame_idx", "share_0", "share_1", "cells_0"])

    keys = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("video_id", "frame_idx"))
    return frames.mapInArrow(kernel, f"{keys}, share_0 double, share_1 double, cells_0 bigint")


def dominance(levels: DataFrame) -> DataFrame:
    """Share of each team in every cell, and the mean shares of a frame come from these."""
    by = lambda t: F.sum(F.when(F.col("team") == t, F.col("influence")).otherwise(0.0))
    cells = levels.groupBy("video_id", "frame_idx", "gx", "gy").agg(by(0).alias("_a"), by(1).alias("_b"))
    total = F.col("_a") + F.col("_b") + 1e-6
    return cells.select("video_id", "frame_idx", "gx", "gy", (F.col("_a") / total).alias("share_0"), (F.col("_b") / total).alias("share_1"))


def line_heat(segments: DataFrame, sigma: float = 3.0, radius: int = 6) -> DataFrame:
    """class_idx, frame_id, px, py, heat: the largest Gaussian splat of a segment's integer steps.

    segments: frame_id, class_idx, ax, ay, bx, by in heat-map pixels.
    """
    steps = F.greatest(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))).cast("int"), F.lit(1))
    rows = segments.withColumn("_n", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: (F.col(a) + (F.col(b) - F.col(a)) * F.col("_k") / F.col("_n")).cast("int")
    rows = rows.select("frame_id", "class_idx", at("ax", "bx").alias("_x"), at("ay", "by").alias("_y")).distinct()
    around = F.sequence(F.lit(-radius), F.lit(radius))
    rows = rows.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    heat: Column = F.exp(-(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / F.lit(2 * sigma * sigma))
    return rows.groupBy("frame_id", "class_idx", (F.col("_x") + F.col("_dx")).alias("px"), (F.col("_y") + F.col("_dy")).alias("py")).agg(F.max(heat).alias("heat"))


def motion_plan(moving: DataFrame, length: int = 20, arrow: float = 2.0, least: float = 0.1) -> DataFrame:
    """Drawing primitives of what moves: kind (trail or arrow), px, py, px2, py2, gray.

    moving: video_id, track_id, frame_idx, x, y, vx, vy. A trail links each of a track's last length
    points to the next one, the later the brighter; an arrow of fixed length points where a player runs
    who is faster than least along an axis, up to the edge of the picture. What begins far off the pitch
    is not drawn, nor a trail that ends there.
    """
    from touchline.functions.geometry import diagram_pixel

    near = lambda x, y: (F.abs(x) <= HALF_LENGTH + 5) & (F.abs(y) <= HALF_WIDTH + 5)
    keys = ["video_id", "track_id", "frame_idx"]
    order = Window.partitionBy("video_id", "track_id").orderBy("frame_idx")
    recent = F.collect_list(F.struct("x", "y")).over(order.rowsBetween(1 - length, 0))
    held = moving.select(*keys, recent.alias("_t")).filter(F.size("_t") > 1).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_t") - 1)))
    a, b = F.get("_t", F.col("_k") - 1), F.get("_t", F.col("_k"))
    line = held.select(*keys, F.lit("trail").alias("kind"), a.alias("_a"), b.alias("_b"), (100 + 155 * (F.col("_k") / F.size("_t"))).cast("int").alias("gray"))
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    tip = F.struct((F.col("x") + arrow * F.col("vx") / speed).alias("x"), (F.col("y") + arrow * F.col("vy") / speed).alias("y"))
    runs = moving.filter((F.abs("vx") > least) | (F.abs("vy") > least))
    arrows = runs.select(*keys, F.lit("arrow").alias("kind"), F.struct("x", "y").alias("_a"), tip.alias("_b"), F.lit(None).cast("int").alias("gray"))
    both = line.unionByName(arrows).filter(near(F.col("_a.x"), F.col("_a.y")) & (near(F.col("_b.x"), F.col("_b.y")) | (F.col("kind") == "arrow")))
    (px, py), (px2, py2) = diagram_pixel(F.col("_a.x"), F.col("_a.y")), diagram_pixel(F.col("_b.x"), F.col("_b.y"))
    inside = lambda v, size: F.when(F.col("kind") == "arrow", F.greatest(F.lit(0), F.least(F.lit(size - 1), v))).otherwise(v)
    return both.select(*keys, "kind", px.alias("px"), py.alias("py"), inside(px2, 1150).alias("px2"), inside(py2, 780).alias("py2"), "gray")


def render_plan(frames: DataFrame) -> DataFrame:
    """One drawing primitive per player and frame: kind, pixel, colour, label.

    frames: video_id, frame_idx, track_id, slot_key, role, team, x, y.
    """
    from touchline.functions.geometry import diagram_pixel

    px, py = diagram_pixel(F.col("x"), F.col("y"))
    label = F.when(F.col("role") == "goalie", F.concat(F.lit("GK:"), F.coalesce("slot_key", F.concat(F.lit("?"), F.col("track_id"))))).when(F.col("role") == "referee", "REF").when(F.col("role") == "linesman", "LN")
    label = label.otherwise(F.coalesce("slot_key", F.concat(F.lit("?"), F.col("track_id").cast("string"))))
    seen = frames.filter((F.abs("x") <= HALF_LENGTH + 5) & (F.abs("y") <= HALF_WIDTH + 5))
    return seen.select("video_id", "frame_idx", "track_id", F.lit("circle").alias("kind"), px.alias("px"), py.alias("py"), F.when(F.col("team").isin(0, 1), F.col("team")).otherwise(2).alias("colour"), label.alias("label"))
