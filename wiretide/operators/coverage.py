"""Polling intervals, and whether the capture is long enough to show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Requests that an interval takes, and intervals that a window must hold.
LEAST_REQUESTS, MULTIPLIER = 2, 2.0
#: Packet numbers of a cell.
CELL = 100_000


def polling_cycles(events: DataFrame) -> DataFrame:
    """(capture_id, session_id, measured_cycle_s, request_count): longest gap between consecutive
    requests of any protocol in file order, which can be negative.

    A session is cut into cells of packet numbers, in which gaps are found apart from each other; the
    gaps between cells come from their first and last requests. So no task gets a whole busy session.
    """
    key = ["capture_id", "session_id", "cell"]
    asked = events.filter("direction = 'request'").withColumn("cell", F.floor(F.col("packet_number") / CELL))
    asked = asked.select(*key, F.struct("packet_number", "protocol").alias("at"), "timestamp")
    gaps = asked.withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy(*key).orderBy("at")))
    cells = gaps.groupBy(*key).agg(F.max("gap").alias("gap"), F.min_by("timestamp", "at").alias("first"), F.max_by("timestamp", "at").alias("last"), F.count(F.lit(1)).alias("n"))
    between = cells.withColumn("jump", F.col("first") - F.lag("last").over(Window.partitionBy("capture_id", "session_id").orderBy("cell")))
    out = between.groupBy("capture_id", "session_id").agg(F.bround(F.greatest(F.max("gap"), F.max("jump")), 6).alias("measured_cycle_s"), F.sum("n").alias("request_count"))
    return out.filter(F.col("request_count") >= LEAST_REQUESTS)


def short_windows(cycles: DataFrame, windows: DataFrame) -> DataFrame:
    """Cycles of which the capture's window (capture_id, duration_s) holds less than MULTIPLIER.

    A gap of zero and a capture without a window warn of nothing; a window of exactly that length is
    long enough.
    """
    joined = cycles.join(windows.select("capture_id", "duration_s"), "capture_id")
    return joined.filter((F.col("measured_cycle_s") != 0) & (F.col("duration_s") < MULTIPLIER * F.col("measured_cycle_s")))
