"""Ring tracks derived from the events table: one track per user, one line per event.

The shape has turns both ways, runs of lines where the driven line touches an edge, and exact ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = """
with ev0 as (select user_id track_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) idx,
                  cast(count(*) over (partition by user_id) as bigint) n, value from events where user_id is not null),
     ev1 as (select *, 2 * pi() * idx / n th, 5 + (idx * 7) % 5 hw from ev0),
     ev2 as (select *, 1000 + track_id % 50 + 40 * sin(6 * th) r0 from ev1),
     tracks as (select track_id, idx, n, (r0 - hw) * cos(th) x1, (r0 - hw) * sin(th) y1, (r0 + hw) * cos(th) x2, (r0 + hw) * sin(th) y2,
                       greatest(cast(0 as double), least(cast(1 as double), 0.5 + 0.55 * sin(5 * th))) pos,
                       cast(10 + value % 70 as double) vel, r0, th from ev2),
     predicted as (select track_id, idx, n, x1, y1, x2, y2, greatest(cast(0 as double), least(cast(1 as double), 0.5 + 0.5 * sin(5 * th + 0.3))) pos,
                          cast(10 + (idx * 31) % 70 as double) vel from tracks),
     path as (select track_id, idx, n, (r0 + 3 * sin(9 * th)) * cos(th + 0.01) x, (r0 + 3 * sin(9 * th)) * sin(th + 0.01) y, vel, cast(idx % 7 as double) - 3 acc from tracks)
"""


def _view(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(BASE.replace("from events", "from {events}") + what, events=events)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "select track_id, idx, n, x1, y1, x2, y2, pos, vel from tracks")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "select * from predicted")


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "select track_id, idx, x, y, vel, acc from path")
