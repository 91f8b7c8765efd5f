"""Colours of player crops as aggregates over their pixels, and the crop kernels as SQL functions.

crops: crop_id (a key), height, width, pixels (binary, height * width RGB bytes), as in colours. Pixels are rows for the
length of one aggregate: each crop's are folded in the task that has the crop, and only sums are shuffled. A crop without
pixels keeps its row and has no colour; so has one whose pixels are all left out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import colours

#: Bins of hue (0..179), saturation and value (0..255).
BINS = (8, 12, 8)


def rows_of(crops: DataFrame) -> DataFrame:
    """crop_id, height, width, y, x, r, g, b of every pixel; one row without a pixel for an empty crop."""
    size = F.col("width") * 3
    some = (F.col("height") > 0) & (F.col("width") > 0) & (F.length("pixels") == F.col("height") * size)
    # the image is bound once and cut into lines, so that no pixel's row carries it whole
    lines = F.transform(F.array("pixels"), lambda p: F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: p.substr(y * size + 1, size)))[0]
    cut = crops.select("crop_id", "height", "width", F.posexplode_outer(F.when(some, lines)).alias("y", "_line"))
    each = cut.select("crop_id", "height", "width", "y", "_line", F.explode_outer(F.when(F.col("y").isNotNull(), F.sequence(F.lit(0), F.col("width") - 1))).alias("x"))
    shade = lambda k: F.conv(F.hex(F.substring("_line", F.col("x") * 3 + 1 + k, F.lit(1))), 16, 10).cast("double")
    return each.select("crop_id", "height", "width", "y", "x", *(shade(k).alias(c) for k, c in enumerate("rgb")))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value of 8 bits each, as colours.hsv gives them."""
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    turn = F.when(top == r, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.when(span > 0, F.rint(F.pmod(turn, F.lit(360.0)) / 2) % 180).otherwise(F.when(span == 0, F.lit(0.0)))
    return hue, F.rint(255 * span / F.greatest(top, F.lit(1.0))), top


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab under D65, as colours.lab gives it."""
    c = [v / 255 for v in (r, g, b)]
    c = [F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92) for v in c]
    weights = ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754))
    x, y, z = ((c[0] * p + c[1] * q + c[2] * s) / white for p, q, s, white in weights)
    fx, fy, fz = (F.when(v > 0.008856, F.cbrt(v)).otherwise(v * 7.787 + 16 / 116) for v in (x, y, z))
    light = F.when(y > 0.008856, fy * 116 - 16).otherwise(y * 903.3)
    return light * 2.55, (fx - fy) * 500 + 128, (fy - fz) * 200 + 128


def _cut(size: str, share: float) -> Column:
    return F.floor(F.col(size) * F.lit(share)).cast("int")


def _converted(crops: DataFrame, use: Column, *spaces: Callable) -> DataFrame:
    """The pixels in use with h, s, v or l, a, b; a crop of which none is in use keeps one row without them."""
    rows = rows_of(crops).withColumns({c: F.when(use, F.col(c)) for c in "rgb"})
    for space in spaces:
        names = ("h", "s", "v") if space is hsv else ("l", "a", "b_")
        rows = rows.withColumns(dict(zip(names, space(*map(F.col, "rgb")), strict=True)))
    return rows


def torso_colours(crops: DataFrame) -> DataFrame:
    """crop_id, hue, saturation, value: means over the upper 60 % of a crop, NULL where it has no pixels."""
    rows = _converted(crops, F.col("y") < _cut("height", 0.6), hsv)
    return rows.groupBy("crop_id").agg(*(F.avg(c).alias(n) for c, n in (("h", "hue"), ("s", "saturation"), ("v", "value"))))


def jersey_colours(crops: DataFrame, least: int = 5) -> DataFrame:
    """crop_id and colour: mean Lab of shirt and shorts as colours.jersey gives it, NULL where neither has enough pixels.

    A part of which under `least` pixels are left after the damping of green is zeros.
    """
    fits = (F.col("height") >= 15) & (F.col("width") >= 5)
    margin = _cut("width", 0.3)
    rows = _converted(crops, fits & (F.col("x") >= margin) & (F.col("x") < F.col("width") - margin), hsv, lab)
    apart = F.abs(F.col("h") - 60)
    weight = F.least(F.least(apart, 180 - apart) / 30, F.lit(1.0)) * (1 - F.col("s") / 510)
    rows = rows.withColumn("_w", weight)
    sums = []
    for part, (low, high) in enumerate(((0.1, 0.5), (0.4, 0.9))):
        inside = (F.col("_w") > 0.2) & (F.col("y") >= _cut("height", low)) & (F.col("y") < _cut("height", high))
        sums += [F.count_if(inside).alias(f"_n{part}"), F.sum(F.when(inside, F.col("_w"))).alias(f"_t{part}"), *(F.sum(F.when(inside, F.col("_w") * F.col(c))).alias(f"_{c}{part}") for c in ("l", "a", "b_"))]
    mean = lambda c, part: F.when(F.col(f"_n{part}") >= least, F.col(f"_{c}{part}") / F.col(f"_t{part}")).otherwise(F.lit(0.0))
    made = F.array(*(mean(c, part) for part in (0, 1) for c in ("l", "a", "b_")))
    enough = (F.col("_n0") >= least) | (F.col("_n1") >= least)
    return rows.groupBy("crop_id").agg(*sums).select("crop_id", F.when(enough, made).alias("colour"))


def histograms(crops: DataFrame, bins: tuple[int, int, int] = BINS, masked: bool = True) -> DataFrame:
    """crop_id, bin, share: the HSV histogram of a crop, of unit length, its empty bins left out.

    masked: of the jersey alone (rows of 10 to 50 %, 20 % less at either side, no green). bin counts as in the flat
    vector of colours.histogram; crops without a pixel in use have no rows.
    """
    use = F.lit(True)
    if masked:
        margin = _cut("width", 0.2)
        use = (F.col("y") >= _cut("height", 0.1)) & (F.col("y") < _cut("height", 0.5)) & (F.col("x") >= margin) & (F.col("x") < F.col("width") - margin)
    rows = _converted(crops, use, hsv).filter(F.col("v").isNotNull())
    if masked:
        rows = rows.filter(~(F.col("h").between(35, 85) & (F.col("s") >= 40) & (F.col("v") >= 40)))
    place = lambda c, n, top: F.floor(F.col(c) * n / top)
    number = (place("h", bins[0], 180) * bins[1] + place("s", bins[1], 256)) * bins[2] + place("v", bins[2], 256)
    counts = rows.groupBy("crop_id", number.cast("int").alias("bin")).agg(F.count("*").alias("_n"))
    # a crop has at most as many rows as there are bins
    whole = counts.groupBy("crop_id").agg(F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_length"))
    return counts.join(whole, "crop_id").select("crop_id", "bin", (F.col("_n") / F.col("_length")).alias("share"))


def overlaps(pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """pairs (crop_a, crop_b) with overlap, the sum of the lesser shares over all bins; 0.0 where none is shared."""
    a = shares.select(F.col("crop_id").alias("crop_a"), "bin", F.col("share").alias("_a"))
    b = shares.select(F.col("crop_id").alias("crop_b"), "bin", F.col("share").alias("_b"))
    wanted = pairs.select("crop_a", "crop_b").distinct()
    met = wanted.join(a, "crop_a").join(b, ["crop_b", "bin"]).groupBy("crop_a", "crop_b").agg(F.sum(F.least("_a", "_b")).alias("overlap"))
    return wanted.join(met, ["crop_a", "crop_b"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def _arrow_function(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable:
    def run(pixels: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        made = []
        for p, h, w in zip(pixels.to_pylist(), height.to_pylist(), width.to_pylist(), strict=True):
            whole = p and h and w and len(p) == 3 * h * w
            vector = kernel(np.frombuffer(p, np.uint8).reshape(h, w, 3)) if whole else np.zeros(1)
            made.append(vector.tolist() if np.any(vector) else None)
        return pa.array(made, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def register(spark: SparkSession, **kernels: Callable[[np.ndarray], np.ndarray]) -> None:
    """Make kernels (image of height x width x 3 bytes to a vector) SQL functions of (pixels, height, width).

    The crop kernels are always registered, as jersey_colour, dominant_colour, torso_colour and crop_histogram;
    a name of one's own takes its place. NULL for empty or broken images and for vectors that are all zero.
    """
    own = {"jersey_colour": colours.jersey, "dominant_colour": colours.dominant, "torso_colour": colours.torso, "crop_histogram": colours.histogram}
    for name, kernel in (own | kernels).items():
        spark.udf.register(name, _arrow_function(kernel))
