"""Queries over the pixels of player crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.geometry import r6
from touchline.operators import pixels
from touchline.sources.fixtures import table

#: Size of the painted crops.
HEIGHT, WIDTH = 30, 12


def _crops(spark: SparkSession, d: str) -> DataFrame:
    """A crop painted from each embedding."""
    shade = F.transform(F.sequence(F.lit(0), F.lit(HEIGHT * WIDTH * 3 - 1)), lambda k: F.lpad(F.hex(F.pmod(F.floor(F.col("embedding")[(k % 64).cast("int")].cast("double") * 1000) * 7 + k * k, F.lit(256))), 2, "0"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("crop_id"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.unhex(F.array_join(shade, "")).alias("pixels"))


def torso_colours(spark: SparkSession, d: str) -> DataFrame:
    return pixels.torso_colours(_crops(spark, d)).select("crop_id", *(r6(F.col(c)).alias(c) for c in ("hue", "saturation", "value")))


def jersey_colours(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels.jersey_colours(_crops(spark, d))
    return rows.select("crop_id", *(r6(F.col("colour")[k]).alias(c) for k, c in enumerate(_LAB)))


def crop_histograms(spark: SparkSession, d: str) -> DataFrame:
    return pixels.histograms(_crops(spark, d)).withColumn("share", r6(F.col("share")))


def histogram_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """How much the jerseys of neighbouring crops agree."""
    shares = pixels.histograms(_crops(spark, d))
    pairs = table(spark, d, "embeddings").select(F.col("vec_id").alias("crop_a"), (F.col("vec_id") + 1).alias("crop_b"))
    return pixels.overlaps(pairs, shares).withColumn("overlap", r6(F.col("overlap")))


def dominant_colours(spark: SparkSession, d: str) -> DataFrame:
    """The two main colours of every crop, by the SQL function."""
    pixels.register(spark)
    return _crops(spark, d).selectExpr("crop_id", "dominant_colour(pixels, height, width) as colour")


_LAB = ("shirt_l", "shirt_a", "shirt_b", "shorts_l", "shorts_a", "shorts_b")
QUERIES = {f.__name__: f for f in (torso_colours, jersey_colours, crop_histograms, histogram_overlaps, dominant_colours)}

_PIXELS = f"""with bytes as (select vec_id as crop_id, k, (((floor(embedding[k % 64 + 1]::double * 1000)::bigint * 7 + k * k) % 256) + 256) % 256 as shade from embeddings, (select unnest(range({HEIGHT * WIDTH * 3})) as k)),
  px as (select crop_id, k // 3 // {WIDTH} as y, k // 3 % {WIDTH} as x, max(shade) filter (k % 3 = 0)::double as r, max(shade) filter (k % 3 = 1)::double as g, max(shade) filter (k % 3 = 2)::double as b from bytes group by all),
  spans as (select *, greatest(r, g, b) as v, greatest(r, g, b) - least(r, g, b) as span from px),
  turns as (select *, case when span = 0 then 0 when v = r then 60 * (g - b) / span when v = g then 120 + 60 * (b - r) / span else 240 + 60 * (r - g) / span end as turn from spans),
  hsv as (select crop_id, y, x, r, g, b, v, round_even((((turn % 360) + 360) % 360) / 2, 0) % 180 as h, round_even(255 * span / greatest(v, 1), 0) as s from turns)"""
_LINEAR = ", ".join(f"case when {c} / 255e0 > 0.04045e0 then pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) else {c} / 255e0 / 12.92e0 end as l{c}" for c in "rgb")
_F = ", ".join(f"case when {c} > 0.008856e0 then cbrt({c}) else {c} * 7.787e0 + 16e0 / 116 end as f{c}" for c in ("xx", "yy", "zz"))
_JERSEY = f"""{_PIXELS},
  lin as (select *, {_LINEAR}, least(least(abs(h - 60), 180 - abs(h - 60)) / 30, 1e0) * (1 - s / 510) as w from hsv where x >= {int(WIDTH * 0.3)} and x < {WIDTH - int(WIDTH * 0.3)}),
  xyz as (select *, (lr * 0.412453e0 + lg * 0.357580e0 + lb * 0.180423e0) / 0.950456e0 as xx, lr * 0.212671e0 + lg * 0.715160e0 + lb * 0.072169e0 as yy, (lr * 0.019334e0 + lg * 0.119193e0 + lb * 0.950227e0) / 1.088754e0 as zz from lin where w > 0.2e0),
  cube as (select *, {_F} from xyz),
  lab as (select crop_id, y, w, case when yy > 0.008856e0 then fyy * 116 - 16 else yy * 903.3e0 end * 2.55e0 as l, (fxx - fyy) * 500 + 128 as a, (fyy - fzz) * 200 + 128 as b from cube),
  parts as (select crop_id, part, count(*) as n, {', '.join(f'sum(w * {c}) / sum(w) as {c}' for c in 'lab')} from lab, (values ('shirt', {int(HEIGHT * 0.1)}, {int(HEIGHT * 0.5)}), ('shorts', {int(HEIGHT * 0.4)}, {int(HEIGHT * 0.9)})) t(part, low, high) where y >= low and y < high group by 1, 2 having count(*) >= 5)"""
_HISTOGRAM = f"""{_PIXELS},
  cells as (select crop_id, cast((floor(h * 8 / 180) * 12 + floor(s * 12 / 256)) * 8 + floor(v * 8 / 256) as int) as bin, count(*) as n from hsv
    where y >= {int(HEIGHT * 0.1)} and y < {int(HEIGHT * 0.5)} and x >= {int(WIDTH * 0.2)} and x < {WIDTH - int(WIDTH * 0.2)} and not (h between 35 and 85 and s >= 40 and v >= 40) group by 1, 2),
  hist as (select crop_id, bin, n / sqrt(sum(n * n) over (partition by crop_id)) as share from cells)"""

ORACLES = {
    "torso_colours": f"{_PIXELS} select crop_id, round(avg(h), 6) + 0.0 as hue, round(avg(s), 6) + 0.0 as saturation, round(avg(v), 6) + 0.0 as value from hsv where y < {int(HEIGHT * 0.6)} group by 1",
    "jersey_colours": f"""{_JERSEY}
        select e.vec_id as crop_id, {', '.join(f"round(case when p.n is null and q.n is null then null else coalesce({'pq'[k // 3]}.{'lab'[k % 3]}, 0) end, 6) + 0.0 as {name}" for k, name in enumerate(_LAB))}
        from embeddings e left join parts p on p.crop_id = e.vec_id and p.part = 'shirt' left join parts q on q.crop_id = e.vec_id and q.part = 'shorts'""",
    "crop_histograms": f"{_HISTOGRAM} select crop_id, bin, round(share, 6) + 0.0 as share from hist",
    "histogram_overlaps": f"""{_HISTOGRAM},
        met as (select a.crop_id as crop_a, b.crop_id as crop_b, sum(least(a.share, b.share)) as overlap from hist a join hist b on b.crop_id = a.crop_id + 1 and b.bin = a.bin group by 1, 2)
        select distinct vec_id as crop_a, vec_id + 1 as crop_b, round(coalesce(overlap, 0), 6) + 0.0 as overlap from embeddings left join met on crop_a = vec_id""",
}
