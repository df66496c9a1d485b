"""A capture as a view of the events table, for data that comes without packets.

Each event is a TCP packet between two of twenty hosts. Ports, flags and payloads follow from the
event's columns, so both sides of a comparison can compute the same packets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.octets import crc16_of
from ..operators.recognise import FUNCTION_CODES
from ..session import table

CAPTURE = "events"
UNITS = 5

#: Payloads as hex text: request lines, a status line, negotiation bytes, a control verb.
HTTP_GET = b"GET /status HTTP/1.1\r\n\r\n".hex().upper()
HTTP_OK = b"HTTP/1.1 200 OK\r\n\r\n".hex().upper()
TELNET = "FFFB01"
FTP = b"USER reader\r\n".hex().upper()
READ, WRITE = "00000001", "060001002A"
#: Function codes of the requests of clicks: all known ones and one that is not.
CODES = [*FUNCTION_CODES, 99]


def rtu_frame(unit: int) -> str:
    body = bytes.fromhex(f"{unit:02X}" + WRITE)
    return (body + crc16_of(body).to_bytes(2, "little")).hex().upper()


def events_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP packets of the capture that the events make (see operators.decode.TCP_COLUMNS)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.regexp_extract("props", r"\d+", 0).cast("int").alias("k"))
    src, other = F.col("user_id") % 20, F.col("k") % 20
    dst = F.when(src == other, (other + 1) % 20).otherwise(other)
    lane = (F.col("event_id") % 16 + 1) * 1000
    unit = F.col("k") % UNITS + 1
    adu = lambda pdu: F.concat(F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"), F.lit("00000006"), F.lpad(F.hex(unit), 2, "0"), pdu if isinstance(pdu, Column) else F.lit(pdu))
    broken = F.concat(F.lit("00010001000601"), F.lit(WRITE))
    frames = F.create_map(*(x for u in range(1, UNITS + 1) for x in (F.lit(u), F.lit(rtu_frame(u)))))
    which = F.col("k") % 6
    error = F.when(which == 0, HTTP_GET).when(which == 1, F.element_at(frames, unit.cast("int"))).when(which == 2, broken).when(which == 3, TELNET).when(which == 4, FTP).otherwise(HTTP_OK)
    code = F.element_at(F.array(*(F.lit(f"{c:02X}") for c in CODES)), (F.floor(F.col("event_id") / 16) % len(CODES) + 1).cast("int"))
    payload = F.when(F.col("event_type") == "click", adu(F.concat(code, F.lit(READ)))).when(F.col("event_type") == "purchase", adu(WRITE)).when(F.col("event_type") == "error", error).otherwise("")

    def mac(host, moved):
        card = F.concat(F.lit("02:00:"), F.lpad(F.lower(F.hex(host % 4)), 2, "0"), F.when(moved, ":01:00:").otherwise(":00:00:"), F.lpad(F.lower(F.hex(host)), 2, "0"))
        return F.when(host != 19, card)

    host = lambda h: F.concat(F.lit("10.0.0."), h.cast("string"))
    moved = (F.col("event_id") % 997 == 5) & (src == 7)
    return e.select(
        F.lit(CAPTURE).alias("capture_id"),
        (F.col("event_id") + 1).alias("packet_number"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        host(src).alias("src_ip"),
        (lane + src).cast("int").alias("src_port"),
        host(dst).alias("dst_ip"),
        (lane + dst).cast("int").alias("dst_port"),
        mac(src, moved).alias("src_mac"),
        mac(dst, F.lit(False)).alias("dst_mac"),
        F.round(F.col("value") * 100).cast("long").alias("wire_length"),
        (F.col("event_type") == "signup").alias("syn"),
        (F.col("event_type") != "signup").alias("ack"),
        F.unhex(payload).alias("payload"),
    )


_FRAMES = " ".join(f"WHEN {u} THEN '{rtu_frame(u)}'" for u in range(1, UNITS + 1))

_CODES = ", ".join(f"'{c:02X}'" for c in CODES)
_KNOWN = ", ".join(f"({c}, '{kind}', '{name}')" for c, (kind, name) in FUNCTION_CODES.items())
_CRC = "list_reduce(list_concat([65535], range(0, n - 2)), lambda crc, i: list_reduce(list_concat([xor(crc, TRY_CAST('0x' || substr(h, 2 * CAST(i AS BIGINT) + 1, 2) AS BIGINT))], [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 40961) ELSE c // 2 END))"

#: The same packets, sessions, segments and events as DuckDB common table expressions.
SQL = f"""
e AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id % 20 AS s, event_type, value,
             CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, CASE WHEN user_id % 20 = k % 20 THEN (k + 1) % 20 ELSE k % 20 END AS d FROM events),
raw AS (SELECT event_id + 1 AS pn, ts_us, event_id, '10.0.0.' || s AS src_ip, '10.0.0.' || d AS dst_ip, s, d,
               CAST(1000 * (event_id % 16 + 1) + s AS INT) AS src_port, CAST(1000 * (event_id % 16 + 1) + d AS INT) AS dst_port,
               CAST(round(value * 100) AS BIGINT) AS wire, event_type = 'signup' AS syn, k % {UNITS} + 1 AS unit,
               CASE event_type
                 WHEN 'click' THEN printf('%04X', event_id % 65536) || '00000006' || printf('%02X', k % {UNITS} + 1) || list_extract([{_CODES}], CAST(event_id // 16 % {len(CODES)} + 1 AS INT)) || '{READ}'
                 WHEN 'purchase' THEN printf('%04X', event_id % 65536) || '00000006' || printf('%02X', k % {UNITS} + 1) || '{WRITE}'
                 WHEN 'error' THEN CASE k % 6 WHEN 0 THEN '{HTTP_GET}' WHEN 1 THEN CASE k % {UNITS} + 1 {_FRAMES} END
                   WHEN 2 THEN '00010001000601{WRITE}' WHEN 3 THEN '{TELNET}' WHEN 4 THEN '{FTP}' ELSE '{HTTP_OK}' END
                 ELSE '' END AS h
        FROM e),
tcp AS (SELECT *, CASE WHEN s = 19 THEN NULL ELSE '02:00:' || printf('%02x', s % 4) || CASE WHEN event_id % 997 = 5 AND s = 7 THEN ':01:00:' ELSE ':00:00:' END || printf('%02x', s) END AS src_mac,
               CASE WHEN d = 19 THEN NULL ELSE '02:00:' || printf('%02x', d % 4) || ':00:00:' || printf('%02x', d) END AS dst_mac,
               CASE WHEN (src_ip, src_port) < (dst_ip, dst_port) THEN src_ip || ':' || src_port || '<->' || dst_ip || ':' || dst_port
                    ELSE dst_ip || ':' || dst_port || '<->' || src_ip || ':' || src_port END AS key,
               src_ip || ':' || src_port AS a, dst_ip || ':' || dst_port AS b FROM raw),
sess AS (SELECT key, first_packet, row_number() OVER (ORDER BY first_packet) - 1 AS session_id
         FROM (SELECT key, min(pn) AS first_packet FROM tcp WHERE h <> '' GROUP BY key)),
seg AS (SELECT tcp.*, session_id FROM tcp JOIN sess USING (key) WHERE h <> ''),
shaped AS (SELECT *, length(h) // 2 AS n,
             coalesce(length(h) >= 16 AND substr(h, 5, 4) = '0000' AND TRY_CAST('0x' || substr(h, 9, 4) AS INT) = length(h) // 2 - 6, false) AS is_mbap FROM seg),
found AS (
  SELECT *, 'modbus-tcp' AS protocol, TRY_CAST('0x' || substr(h, 15, 2) AS INT) AS fc, TRY_CAST('0x' || substr(h, 13, 2) AS INT) AS unit_id FROM shaped WHERE is_mbap
  UNION ALL SELECT *, 'telnet', NULL, NULL FROM shaped WHERE n >= 3 AND substr(h, 1, 4) IN ('FFFA', 'FFFB', 'FFFC', 'FFFD', 'FFFE')
  UNION ALL SELECT *, 'ftp', NULL, NULL FROM shaped WHERE n >= 4 AND regexp_matches(h, '^(55534552|50415353|52455452|53544F52|4C495354|51554954|505744|435744|54595045|504F5254|50415356)(20|0D)|^(3[0-9]){{3}}(20|2D)')
  UNION ALL SELECT *, 'http', NULL, NULL FROM shaped WHERE n >= 14 AND regexp_matches(h, '^(474554|504F5354|505554|44454C455445|48454144|4F5054494F4E53)20([0-9A-F]{{2}})*485454502F312E3[01]|^485454502F312E3[01]20(3[0-9]){{3}}')),
high AS (SELECT found.*, CASE WHEN src_ip = c.cip AND src_port = c.cport THEN 'request' ELSE 'response' END AS direction,
                CASE WHEN fc IS NOT NULL THEN coalesce(known.kind, 'unknown') END AS kind, CASE WHEN fc IS NOT NULL THEN coalesce(known.name, 'Unknown') END AS function_name
         FROM found LEFT JOIN (VALUES {_KNOWN}) known(code, kind, name) ON fc = known.code JOIN (SELECT session_id, protocol, arg_min(src_ip, pn) AS cip, arg_min(src_port, pn) AS cport FROM found GROUP BY ALL) c USING (session_id, protocol)),
low AS (SELECT * FROM (SELECT *, {_CRC} AS crc FROM shaped WHERE NOT is_mbap AND n >= 4)
        WHERE TRY_CAST('0x' || substr(h, 1, 2) AS INT) BETWEEN 1 AND 247 AND (TRY_CAST('0x' || substr(h, 3, 2) AS INT) & 127) IN ({", ".join(map(str, FUNCTION_CODES))})
          AND crc = TRY_CAST('0x' || substr(h, 2 * n - 1, 2) || substr(h, 2 * n - 3, 2) AS BIGINT)),
vol AS (SELECT session_id, CAST(sum(wire) AS BIGINT) AS volume_bytes, count(*) AS packets FROM tcp JOIN sess USING (key) GROUP BY session_id),
init AS (SELECT session_id, arg_min(a, pn) AS initiator FROM tcp JOIN sess USING (key) WHERE syn GROUP BY session_id),
firsts AS (SELECT session_id, arg_min(a, pn) AS fa, arg_min(b, pn) AS fb FROM seg GROUP BY session_id),
strong AS (SELECT session_id, string_agg(DISTINCT protocol, '+' ORDER BY protocol) AS label FROM high GROUP BY session_id),
weak AS (SELECT DISTINCT session_id, 'modbus-rtu-over-tcp' AS label FROM low),
matrix AS (SELECT session_id, coalesce(initiator, fa) AS source, CASE WHEN initiator IS NOT NULL AND fa <> initiator THEN fa ELSE fb END AS target,
                  initiator, coalesce(strong.label, weak.label) AS label, volume_bytes, packets
           FROM firsts JOIN vol USING (session_id) LEFT JOIN init USING (session_id) LEFT JOIN strong USING (session_id) LEFT JOIN weak USING (session_id)),
visits AS (SELECT 2 * pn AS place, src_ip AS ip, src_mac AS mac FROM seg UNION ALL SELECT 2 * pn + 1, dst_ip, dst_mac FROM seg),
hosts AS (SELECT ip, min(place) AS place, arg_min(coalesce(mac, ''), place) AS first_mac, min(mac) AS lo, max(mac) AS hi FROM visits GROUP BY ip),
asked AS (SELECT ip, sum(sent) AS sent, sum(received) AS received, list_sort(list(DISTINCT unit_id) FILTER (WHERE unit_id IS NOT NULL)) AS units
          FROM (SELECT src_ip AS ip, 1 AS sent, 0 AS received, NULL AS unit_id FROM high WHERE direction = 'request'
                UNION ALL SELECT dst_ip, 0, 1, unit_id FROM high WHERE direction = 'request') GROUP BY ip),
cycles AS (SELECT session_id, max(gap) AS cycle_us, count(*) AS requests
           FROM (SELECT session_id, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY pn) AS gap FROM high WHERE direction = 'request')
           GROUP BY session_id HAVING count(*) >= 2)
"""
