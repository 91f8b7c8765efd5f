"""Match tables derived from the driver's tables, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: video_id deals the tracks to four matches, so that everything partitions by match.
OBSERVATIONS = """
with e as (
  select event_id, user_id, event_type, value, ts,
         row_number() over (partition by user_id order by ts, event_id) - 1 as rn
  from events),
k as (
  select user_id % 4 as video_id, user_id as track_id,
         cast((user_id % 7) * 10 + rn + floor(rn / 5.0) as bigint) as frame_idx,
         event_id, event_type, value,
         cast((user_id * 37) % 105 - 52 as double) + least(value, 100.0) / 100.0 as px,
         cast((user_id * 53) % 69 - 34 as double) - least(value, 100.0) / 200.0 as py,
         cast(20 + user_id % 7 as double) as bw, cast(50 + event_id % 11 as double) as bh
  from e)
select video_id, track_id, frame_idx, event_id, value,
       960.0 + 15.0 * px - bw / 2 as x1, 540.0 - 10.0 * py - bh as y1,
       960.0 + 15.0 * px + bw / 2 as x2, 540.0 - 10.0 * py as y2,
       case when event_type = 'error' then null else px end as pitch_x,
       case when event_type = 'error' then null else py end as pitch_y,
       1.0 - least(value, 100.0) / 125.0 as score
from k
"""

#: Tracks cut into fragments of 20 frames that lack the last 3.
FRAGMENTS = """
select video_id, track_id * 100 + cast(floor(frame_idx / 20.0) as bigint) as track_id, frame_idx, event_id, value,
       x1, y1, x2, y2, pitch_x, pitch_y, score
from obs where frame_idx % 20 < 17
"""

#: A homography on every fifth frame of a match.
HOMOGRAPHIES = """
select distinct video_id, frame_idx, cast(15 as double) as h00, cast(0 as double) as h01, cast(960 + frame_idx as double) as h02,
       cast(0 as double) as h10, cast(-10 as double) as h11, cast(540 as double) as h12,
       cast(0 as double) as h20, cast(0 as double) as h21, cast(1 as double) as h22
from obs where frame_idx % 5 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBSERVATIONS.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FRAGMENTS.replace("from obs", "from {obs}"), obs=observations(spark, sf_dir))


def homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HOMOGRAPHIES.replace("from obs", "from {obs}"), obs=observations(spark, sf_dir))


#: The views as common table expressions, to start an oracle with.
CTE = f"with recursive obs as ({OBSERVATIONS}), frag as ({FRAGMENTS}), hom as ({HOMOGRAPHIES})"
