"""Observation tables derived from the driver's tables, with whole-number arithmetic, in Spark and in SQL alike.

events are read as detections: a user is a track, eight streams share the users, an hour is a frame of one second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "named_struct('x', cast(event_id * 7 % 600 as double) / 1000, 'y', cast(event_id * 13 % 500 as double) / 1000, 'w', cast(100 + event_id % 200 as double) / 1000, 'h', cast(150 + event_id * 3 % 250 as double) / 1000)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.selectExpr(
        "user_id % 8 as video", "cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 3600 as bigint) as frame_id",
        "event_id as det_idx", "user_id as track", "event_type as class", "cast(40 + event_id * 37 % 61 as bigint) as milli_conf", "cast(40 + event_id * 37 % 61 as double) / 100 as conf", f"{_BOX} as box",
    ).withColumn("time_sec", F.col("frame_id").cast("double"))


DET = """det AS (SELECT user_id % 8 AS video, CAST(epoch_us(ts) // 1000000 - 1704067200 AS BIGINT) // 3600 AS frame_id, event_id AS det_idx, user_id AS track, event_type AS class,
 CAST(40 + event_id * 37 % 61 AS BIGINT) AS milli_conf, CAST(40 + event_id * 37 % 61 AS DOUBLE) / 100 AS conf, CAST(event_id * 7 % 600 AS DOUBLE) / 1000 AS x, CAST(event_id * 13 % 500 AS DOUBLE) / 1000 AS y,
 CAST(100 + event_id % 200 AS DOUBLE) / 1000 AS w, CAST(150 + event_id * 3 % 250 AS DOUBLE) / 1000 AS h, CAST(CAST(epoch_us(ts) // 1000000 - 1704067200 AS BIGINT) // 3600 AS DOUBLE) AS time_sec FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections with their place in their track."""
    from pyspark.sql import Window

    return detections(spark, sf_dir).withColumn("obs_idx", F.row_number().over(Window.partitionBy("video", "track").orderBy("time_sec", "det_idx")) - 1)


OBS = DET + ", obs AS (SELECT *, row_number() OVER (PARTITION BY video, track ORDER BY time_sec, det_idx) - 1 AS obs_idx FROM det)"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as packets of 40 streams in decode order, in groups of four with two reordered."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey % 40 as video", "l_orderkey", "l_linenumber", "cast(l_quantity as bigint) * 100 as size")
    rows = rows.withColumn("decode_idx", F.row_number().over(Window.partitionBy("video").orderBy("l_orderkey", "l_linenumber", "size")) - 1)
    return rows.selectExpr("video", "cast(decode_idx as bigint) as decode_idx", "cast(case decode_idx % 4 when 1 then decode_idx + 2 when 2 then decode_idx - 1 when 3 then decode_idx - 1 else decode_idx end * 1001 as bigint) as pts", "cast(decode_idx * 1001 as bigint) as dts", "cast(1001 as bigint) as dur", "size", "decode_idx % 12 = 0 as key")


PKT = """pkt0 AS (SELECT l_orderkey % 40 AS video, CAST(l_quantity AS BIGINT) * 100 AS size, row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT)) - 1 AS decode_idx FROM lineitem),
pkt AS (SELECT video, decode_idx, CASE decode_idx % 4 WHEN 1 THEN decode_idx + 2 WHEN 2 THEN decode_idx - 1 WHEN 3 THEN decode_idx - 1 ELSE decode_idx END * 1001 AS pts, decode_idx * 1001 AS dts, 1001::BIGINT AS dur, size, decode_idx % 12 = 0 AS key FROM pkt0)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lives of tracks in ticks (hours)."""
    rows = detections(spark, sf_dir).groupBy("video", F.col("track").alias("id")).agg(F.min("frame_id").alias("start"), F.max("frame_id").alias("end"))
    return rows


SPANS = DET + ', spans AS (SELECT video, track AS id, min(frame_id) AS start, max(frame_id) AS "end" FROM det GROUP BY video, track)'
