"""A view of the `events` table as machine sessions: a day of the month is a session. The same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["session_id"]

SQL = """
ml AS (SELECT CAST(day(ts) AS INTEGER) AS session_id,
  row_number() OVER (PARTITION BY day(ts) ORDER BY ts, event_id) - 1 AS row_idx, ts, event_id,
  CAST(1 + floor((hour(ts) % 12) / 2.0) AS INTEGER) AS phase,
  CASE WHEN CAST(1 + floor((hour(ts) % 12) / 2.0) AS INTEGER) = 5 THEN 1 ELSE 0 END AS production,
  value AS feed_rate,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS spindle_speed,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN 'inf' ELSE CAST(value AS VARCHAR) END AS coolant_flow,
  CAST(user_id % 7 AS INTEGER) AS tool_number,
  CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS program_status,
  CAST((event_id * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(0.4 AS DOUBLE)
   + CASE WHEN CAST(1 + floor((hour(ts) % 12) / 2.0) AS INTEGER) = 5 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END
   + CASE WHEN hour(ts) = 3 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS raw_score
 FROM events)"""


def machine_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    hour, kind = F.hour("ts"), c("event_type")
    phase = (1 + F.floor((hour % 12) / 2.0)).cast("int")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("session_id", F.dayofmonth("ts"))
    index = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")) - 1
    status = F.when(kind == "error", 0).when(kind == "click", 1).when(kind == "view", 2).when(kind == "signup", 3).otherwise(4)
    dirty = F.when(c("event_id") % 11 == 0, None).when(c("event_id") % 13 == 0, "n/a").when(c("event_id") % 17 == 0, "inf").otherwise(c("value").cast("string"))
    score = ((c("event_id") * 37) % 100).cast("double") / F.lit(100.0) * F.lit(0.4) + F.when(phase == 5, 0.45).otherwise(0.1) + F.when(hour == 3, 0.4).otherwise(0.0)
    return events.select(
        "session_id", index.cast("long").alias("row_idx"), "ts", "event_id", phase.alias("phase"), F.when(phase == 5, 1).otherwise(0).alias("production"),
        c("value").alias("feed_rate"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("spindle_speed"), dirty.alias("coolant_flow"),
        (c("user_id") % 7).cast("int").alias("tool_number"), status.cast("int").alias("program_status"), score.alias("raw_score"),
    )


def study_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with the sensors under the names of the studies; those it has no reading for are absent, and count as 0."""
    c = F.col
    return machine_log(spark, sf_dir).select(
        "session_id", "row_idx", "ts", "phase", "production",
        (c("event_id") % 2).cast("int").alias("CabinDoorLockFront"), (c("event_id") % 5).cast("int").alias("DNCMode"), (c("raw_score") > 0.5).alias("SpindleApproval"),
        c("program_status").alias("ProgramStatus"), (c("program_status") * 7 + c("tool_number")).alias("ProgramDetail"), c("tool_number").alias("ToolNumber"),
        (c("event_id") % 4).cast("int").alias("DriveStatus"), (c("event_id") % 3).cast("int").alias("DoorStatusMain"),
        c("coolant_flow").alias("CoolantFlow"), (c("raw_score") * 100).alias("OverrideFeed"), c("feed_rate").alias("FeedRate"), c("spindle_speed").alias("SpindleSpeed"),
    )
