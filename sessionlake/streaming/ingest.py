"""Incremental ingest of append-only logs and open delegations over a stream.

Landed batches are immutable Parquet rows (file_path, offset, nbytes, value, landed_at): a file that grows is
landed again in part, and a handle never moves, so (file_path, offset) identifies a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDED = "format string, session_id string, file_path string, offset bigint, nbytes bigint, value string, landed_at timestamp"


def landed_lines(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """The stream of landed lines, each once even if it landed several times within `late`."""
    lines = spark.readStream.schema(LANDED).parquet(path)
    return lines.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(["file_path", "offset"])


def land(stream: DataFrame, path: str, checkpoint: str):
    """Append the stream to a table partitioned by format; returns the query. Each call drains what is there."""
    return stream.writeStream.format("parquet").partitionBy("format").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def open_delegations(launches: DataFrame, notifications: DataFrame, within: str = "interval 24 hours", late: str = "1 hour") -> DataFrame:
    """Launches joined to their notifications by call id; after `within` and the watermark a launch comes out without
    one. launches and notifications: session_id, call_id, ts (and status)."""
    a = launches.withWatermark("ts", late).select("session_id", "call_id", F.col("ts").alias("launched_at"))
    b = notifications.withWatermark("ts", late).select(F.col("session_id").alias("s"), F.col("call_id").alias("c"), F.col("ts").alias("notified_at"), "status")
    on = (F.col("session_id") == F.col("s")) & (F.col("call_id") == F.col("c")) & (F.col("notified_at") >= F.col("launched_at")) & (F.col("notified_at") <= F.col("launched_at") + F.expr(within))
    return a.join(b, on, "left").select("session_id", "call_id", "launched_at", "notified_at", F.coalesce("status", F.lit("running")).alias("status"))
