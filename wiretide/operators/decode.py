"""From packets to TCP packets, sessions, segments and initiators.

Order is part of the data: every row has (capture_id, packet_number), and "first" always means the
smallest packet number. A session is a 4-tuple for the whole capture: no reassembly, no time-outs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import session_key
from ..functions.ranking import number_by_position

#: Columns of TCP packets.
TCP_COLUMNS = ["capture_id", "packet_number", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "src_mac", "dst_mac", "wire_length", "syn", "ack", "payload"]

ETHERNET, RAW_IP, LINUX_COOKED = 1, 101, 113


TCP_SCHEMA = "capture_id string, packet_number long, timestamp double, src_ip string, src_port int, dst_ip string, dst_port int, src_mac string, dst_mac string, wire_length long, syn boolean, ack boolean, payload binary"


def _named(values: np.ndarray, name) -> pa.Array:
    """Text for each number; each distinct number is put into words once."""
    unique, place = np.unique(values, return_inverse=True)
    return pa.array([name(int(v)) for v in unique], pa.string()).take(pa.array(place))


def parse_frames(batch: pa.RecordBatch, trailer_is_payload: bool = True) -> pa.RecordBatch:
    """The IPv4 TCP packets of a batch of frames: header fields of all frames are read at once."""
    frames = batch.column(batch.schema.get_field_index("frame")).cast(pa.large_binary())
    offsets = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + len(frames) + 1]
    raw = frames.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    link = batch.column(batch.schema.get_field_index("linktype")).to_numpy(zero_copy_only=False)

    def u8(at) -> np.ndarray:
        return np.where(at < size, data[np.minimum(start + at, len(data) - 1)], 0).astype(np.int64)

    def u16(at) -> np.ndarray:
        return u8(at) << 8 | u8(at + 1)

    ethernet = link == ETHERNET
    kind_at = np.where(ethernet, 12, 14)
    for _ in range(2):  # up to two VLAN tags
        kind_at = np.where(ethernet & np.isin(u16(kind_at), (0x8100, 0x88A8, 0x9100)), kind_at + 4, kind_at)
    ip_at = np.where(link == RAW_IP, 0, kind_at + 2)
    is_ip = ((link == RAW_IP) | (np.isin(link, (ETHERNET, LINUX_COOKED)) & (u16(kind_at) == 0x0800))) & (u8(ip_at) >> 4 == 4)
    tcp_at = ip_at + (u8(ip_at) & 15) * 4
    keep = is_ip & (u8(ip_at + 9) == 6) & (u16(ip_at + 6) & 0x1FFF == 0) & (tcp_at + 20 <= size)
    at = np.flatnonzero(keep)
    pick = lambda x: x[at]
    word = lambda pos, n: sum(u8(pos + k) << 8 * (n - 1 - k) for k in range(n))
    dotted = lambda v: ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    colons = lambda v: ":".join(f"{v >> s & 255:02x}" for s in (40, 32, 24, 16, 8, 0))
    mac = lambda pos: pc.if_else(pa.array(pick(ethernet)), _named(pick(word(np.full(len(size), pos), 6)), colons), None)
    flags = pick(u8(tcp_at + 13))
    first = pick(tcp_at + (u8(tcp_at + 12) >> 4) * 4)
    end = pick(size) if trailer_is_payload else np.minimum(pick(size), pick(ip_at + u16(ip_at + 2)))
    view = memoryview(raw) if raw is not None else b""
    payload = [bytes(view[s + a : s + max(a, b)]) for s, a, b in zip(pick(start).tolist(), first.tolist(), end.tolist())]
    take = pa.array(at)
    column = lambda n: batch.column(batch.schema.get_field_index(n)).take(take)
    wire = pc.coalesce(column("wirelen").cast(pa.int64()), pa.array(pick(size)))
    columns = [column("capture_id"), column("packet_number"), column("ts"), _named(pick(word(ip_at + 12, 4)), dotted), pa.array(pick(u16(tcp_at)), pa.int32()), _named(pick(word(ip_at + 16, 4)), dotted), pa.array(pick(u16(tcp_at + 2)), pa.int32()), mac(6), mac(0), wire, pa.array(flags & 2 != 0), pa.array(flags & 16 != 0), pa.array(payload, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=TCP_COLUMNS)


def tcp_packets(packets: DataFrame, trailer_is_payload: bool = True) -> DataFrame:
    """IPv4 TCP packets with their header fields.

    Link types: Ethernet with up to two VLAN tags, raw IP, Linux cooked. With trailer_is_payload the
    payload reaches to the end of the captured frame, so link-layer padding counts as payload;
    otherwise it ends where the IP length says. Fragments other than the first are left out. Frames
    come in Arrow batches and their headers are parsed by array operations: as column expressions,
    nested offsets make filters that are too large to compile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield parse_frames(batch, trailer_is_payload)

    return packets.select("capture_id", "packet_number", "ts", "wirelen", "linktype", "frame").mapInArrow(run, TCP_SCHEMA)


def with_key(tcp: DataFrame) -> DataFrame:
    return tcp.withColumn("session_key", session_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")))


def has_payload() -> Column:
    return F.octet_length("payload") > 0


def sessions(tcp: DataFrame) -> DataFrame:
    """(capture_id, session_key, first_packet, session_id): sessions that carry payload, numbered from
    0 in order of their first payload."""
    first = with_key(tcp).filter(has_payload()).groupBy("capture_id", "session_key").agg(F.min("packet_number").alias("first_packet"))
    return number_by_position(first, "capture_id", "first_packet", "session_id")


def segments(tcp: DataFrame, of: DataFrame) -> DataFrame:
    """TCP packets with payload and their session_id."""
    return with_key(tcp).filter(has_payload()).join(of.select("capture_id", "session_key", "session_id"), ["capture_id", "session_key"])


def initiators(tcp: DataFrame, of: DataFrame) -> DataFrame:
    """(capture_id, session_id, ip, port): sender of the first SYN without ACK of each session."""
    opening = with_key(tcp.filter(F.col("syn") & ~F.col("ack")).drop("payload"))
    first = opening.groupBy("capture_id", "session_key").agg(F.min_by(F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), "packet_number").alias("who"))
    return first.join(of.select("capture_id", "session_key", "session_id"), ["capture_id", "session_key"]).select("capture_id", "session_id", "who.ip", "who.port")


def payloadless(tcp: DataFrame, of: DataFrame) -> DataFrame:
    """(capture_id, session_key) of sessions of packets without payload only."""
    keys = with_key(tcp.drop("payload")).select("capture_id", "session_key").distinct()
    return keys.join(of.select("capture_id", "session_key"), ["capture_id", "session_key"], "left_anti")
