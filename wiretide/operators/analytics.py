"""Conversations, session volumes, protocol labels and the communication matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import provenance as P
from ..functions.addresses import endpoint
from .decode import with_key

#: Label of a session that no recogniser knows, and inference methods.
UNRECOGNISED = "tcp"
BY_SHAPE, BY_FIRST_SENDER = "payload-shape", "first-observed-sender"

SESSION = ["capture_id", "session_id"]


def conversations(segments: DataFrame) -> DataFrame:
    """(capture_id, session_id, endpoints sorted, packet_count of packets with payload)."""
    sides = F.array(endpoint(F.col("src_ip"), F.col("src_port")), endpoint(F.col("dst_ip"), F.col("dst_port")))
    # Both directions name the same two endpoints, so the smallest sorted pair is the pair.
    return segments.groupBy(*SESSION).agg(F.min(F.array_sort(F.array_distinct(sides))).alias("endpoints"), F.count(F.lit(1)).alias("packet_count"))


def volumes(tcp: DataFrame, sessions: DataFrame) -> DataFrame:
    """(capture_id, session_id, volume_bytes, packet_count) over all packets of a session.

    Packets are summed by key before the join, so the join has a row for each session.
    """
    sums = with_key(tcp.drop("payload")).groupBy("capture_id", "session_key").agg(F.sum("wire_length").cast("long").alias("volume_bytes"), F.count(F.lit(1)).alias("packet_count"))
    return sums.join(sessions.select("capture_id", "session_key", "session_id"), ["capture_id", "session_key"]).select(*SESSION, "volume_bytes", "packet_count")


def protocol_labels(events: DataFrame) -> DataFrame:
    """(capture_id, session_id, label): the session's protocols, sorted and joined by a plus sign."""
    return events.groupBy(*SESSION).agg(F.array_join(F.array_sort(F.collect_set("protocol")), "+").alias("label"))


def first_senders(segments: DataFrame) -> DataFrame:
    pair = F.struct(endpoint(F.col("src_ip"), F.col("src_port")).alias("source"), endpoint(F.col("dst_ip"), F.col("dst_port")).alias("target"))
    return segments.groupBy(*SESSION).agg(F.min_by(pair, "packet_number").alias("first"), F.min("packet_number").alias("first_packet"))


def matrix(tcp: DataFrame, sessions: DataFrame, segments: DataFrame, high: DataFrame, low: DataFrame, initiators: DataFrame) -> DataFrame:
    """One row of provenance cells for each session with payload, plus capture_id and first_packet."""
    rows = first_senders(segments).join(volumes(tcp, sessions), SESSION)
    rows = rows.join(initiators.select(*SESSION, endpoint(F.col("ip"), F.col("port")).alias("by")), SESSION, "left")
    rows = rows.join(protocol_labels(high).withColumnRenamed("label", "strong"), SESSION, "left").join(protocol_labels(low).withColumnRenamed("label", "weak"), SESSION, "left")
    known = F.col("by").isNotNull()
    source = F.when(known, F.col("by")).otherwise(F.col("first.source"))
    target = F.when(known & (F.col("first.source") != F.col("by")), F.col("first.source")).otherwise(F.col("first.target"))
    marker = F.when(known, P.OBSERVED).otherwise(f"inferred:{BY_FIRST_SENDER}")
    label = F.coalesce("strong", "weak")
    return rows.select(
        "capture_id",
        "first_packet",
        P.observed(F.col("session_id")).alias("session_id"),
        P.cell(source, marker).alias("source"),
        P.cell(target, marker).alias("target"),
        P.cell(F.concat(source, F.lit(" -> "), target), marker).alias("direction"),
        P.cell(F.col("by"), F.when(known, P.OBSERVED).otherwise(P.NOT_DERIVABLE)).alias("initiator"),
        P.cell(F.coalesce(label, F.lit(UNRECOGNISED)), F.when(label.isNotNull(), f"inferred:{BY_SHAPE}").otherwise(P.OBSERVED)).alias("protocol"),
        P.observed(F.col("volume_bytes")).alias("volume_bytes"),
        P.observed(F.col("packet_count")).alias("packet_count"),
    )


def observed_addresses(segments: DataFrame) -> DataFrame:
    return segments.select("capture_id", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()


def zone_model(segments: DataFrame, high: DataFrame) -> DataFrame:
    """(capture_id, members, protocols): one provisional zone with all addresses and one conduit."""
    members = observed_addresses(segments).groupBy("capture_id").agg(F.array_sort(F.collect_set("ip")).alias("members"))
    protocols = high.groupBy("capture_id").agg(F.array_sort(F.collect_set("protocol")).alias("protocols"))
    return members.join(protocols, "capture_id", "left").withColumn("protocols", F.coalesce("protocols", F.array().cast("array<string>")))


def low_confidence_summary(low: DataFrame) -> DataFrame:
    """(capture_id, count, protocols, bases) of the events that stay outside all findings."""
    return low.groupBy("capture_id").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("protocol")).alias("protocols"), F.array_sort(F.collect_set("basis")).alias("bases"))


def capture_summary(packets: DataFrame, time: str = "ts") -> DataFrame:
    """(capture_id, packet_count, first_seen, last_seen, duration_s)."""
    out = packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("packet_count"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    return out.withColumn("duration_s", F.bround(F.col("last_seen") - F.col("first_seen"), 6))
