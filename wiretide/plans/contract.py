"""Queries of the capture engine under the driver contract, each with the SQL that checks it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import provenance as P
from ..operators import analytics, checks, coverage, decode, documents, inventory, recognise, records, standards, textscan
from ..session import cut, table
from ..sources import lens
from . import definitions, plugins
from ..sources.vendors import build_table
from .registry import run_dissectors


class View:
    """What the queries derive from the lens. Frames that several parts of a query read are written to
    the shared folder once, so that no query scans the events more than a few times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tcp = lens.events_lens(spark, sf_dir)

    @cached_property
    def sessions(self) -> DataFrame:
        return cut(decode.sessions(self.tcp), "sessions")

    @cached_property
    def segments(self) -> DataFrame:
        return decode.segments(self.tcp, self.sessions)

    @cached_property
    def events(self) -> DataFrame:
        high, low = run_dissectors(self.segments)
        return cut(high.unionByName(low), "events")

    @property
    def high(self) -> DataFrame:
        return self.events.filter("confidence = 'high'")

    @property
    def low(self) -> DataFrame:
        return self.events.filter("confidence = 'low'")

    @cached_property
    def initiators(self) -> DataFrame:
        return decode.initiators(self.tcp, self.sessions)

    @cached_property
    def matrix(self) -> DataFrame:
        return analytics.matrix(self.tcp, self.sessions, self.segments.drop("payload"), self.high, self.low, self.initiators)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; its SQL may use the lens's tables."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {lens.SQL} {sql}"
        return function

    return put


@query("SELECT key AS session_key, session_id, first_packet FROM sess")
def tcp_sessions(spark, sf_dir):
    return decode.sessions(lens.events_lens(spark, sf_dir)).select("session_key", "session_id", "first_packet")


@query("SELECT session_id, volume_bytes, packets AS packet_count FROM vol")
def session_volume(spark, sf_dir):
    tcp = lens.events_lens(spark, sf_dir)
    return analytics.volumes(tcp, decode.sessions(tcp)).select("session_id", "volume_bytes", "packet_count")


@query("SELECT DISTINCT key AS session_key FROM tcp WHERE key NOT IN (SELECT key FROM sess)")
def payloadless_sessions(spark, sf_dir):
    tcp = lens.events_lens(spark, sf_dir)
    return decode.payloadless(tcp, decode.sessions(tcp)).select("session_key")


@query("SELECT session_id, initiator FROM init")
def session_initiators(spark, sf_dir):
    tcp = lens.events_lens(spark, sf_dir)
    return decode.initiators(tcp, decode.sessions(tcp)).select("session_id", F.concat_ws(":", "ip", "port").alias("initiator"))


@query("SELECT session_id, least(min(a), min(b)) || ',' || greatest(max(a), max(b)) AS endpoints, count(*) AS packet_count FROM seg GROUP BY session_id")
def conversations(spark, sf_dir):
    v = View(spark, sf_dir)
    return analytics.conversations(v.segments).select("session_id", F.array_join("endpoints", ",").alias("endpoints"), "packet_count")


@query("""SELECT pn AS packet_number, session_id, direction, unit_id, fc AS function_code, kind,
  function_name, TRY_CAST('0x' || substr(h, 1, 4) AS INT) AS transaction_id
  FROM high WHERE protocol = 'modbus-tcp'""")
def mbap_events(spark, sf_dir):
    events = recognise.events(View(spark, sf_dir).segments, "modbus-tcp")
    return events.select("packet_number", "session_id", "direction", "unit_id", "function_code", "kind", "function_name", "transaction_id")


@query("SELECT pn AS packet_number, session_id, TRY_CAST('0x' || substr(h, 1, 2) AS INT) AS unit_id, TRY_CAST('0x' || substr(h, 3, 2) AS INT) & 127 AS function_code, TRY_CAST('0x' || substr(h, 3, 2) AS INT) >= 128 AS is_exception FROM low")
def rtu_crc16(spark, sf_dir):
    events = recognise.events(View(spark, sf_dir).segments, "modbus-rtu-over-tcp")
    return events.select("packet_number", "session_id", "unit_id", "function_code", "is_exception")


@query("SELECT pn AS packet_number, session_id, protocol, direction FROM high WHERE protocol <> 'modbus-tcp'")
def http_ftp_telnet(spark, sf_dir):
    high = View(spark, sf_dir).high
    return high.filter("protocol <> 'modbus-tcp'").select("packet_number", "session_id", "protocol", "direction")


@query("SELECT pn AS packet_number, session_id, protocol, 'high' AS confidence FROM high UNION ALL SELECT pn, session_id, 'modbus-rtu-over-tcp', 'low' FROM low")
def dissector_events(spark, sf_dir):
    v = View(spark, sf_dir)
    return v.high.unionByName(v.low).select("packet_number", "session_id", "protocol", "confidence")


@query(
    """SELECT session_id, max(pn) AS packet_number, src_ip, count(*) AS segments FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pn) - row_number() OVER (PARTITION BY session_id, src_ip, src_port ORDER BY pn) AS turn FROM seg)
  GROUP BY session_id, src_ip, src_port, turn"""
)
def session_turns(spark, sf_dir):
    """A plugin called from SQL: its state is one session's current turn."""
    name = plugins.register(spark, "session-turns", plugins.dissector_function("session-turns", "low", plugins.Turns))
    segments = View(spark, sf_dir).segments.drop("payload")
    return spark.sql(f"SELECT session_id, packet_number, src_ip, CAST(transaction_id AS BIGINT) AS segments FROM {name}(TABLE({{rows}}))", rows=segments)


def _findings(check: str, v: View) -> DataFrame:
    spec = definitions.CHECKS[check]
    rows = checks.with_parties(spec["evaluate"](v.high), v.matrix)
    return rows.select(F.lit(check).alias("check_id"), F.lit(spec["severity"]).alias("severity"), checks.risk_of(F.lit(spec["severity"])).alias("risk"), "packet_number", "session_id", "source", "target")


@query("SELECT 'modbus-unauthenticated-write' AS check_id, 'high' AS severity, 'serious' AS risk, pn AS packet_number, session_id, source, target FROM high JOIN matrix USING (session_id) WHERE kind = 'write' AND direction = 'request'")
def write_findings(spark, sf_dir):
    return _findings("modbus-unauthenticated-write", View(spark, sf_dir))


@query("""SELECT 'cleartext-protocol' AS check_id, 'medium' AS severity, 'moderate' AS risk, packet_number, session_id, source, target
  FROM (SELECT session_id, protocol, min(pn) AS packet_number FROM high WHERE protocol IN ('telnet', 'ftp', 'http') GROUP BY ALL) JOIN matrix USING (session_id)""")
def cleartext_findings(spark, sf_dir):
    return _findings("cleartext-protocol", View(spark, sf_dir))


@query("""SELECT 'unauthenticated-industrial-protocol' AS check_id, 'high' AS severity, 'serious' AS risk, packet_number, session_id, source, target
  FROM (SELECT session_id, min(pn) AS packet_number FROM high WHERE protocol = 'modbus-tcp' GROUP BY session_id) JOIN matrix USING (session_id)""")
def industrial_findings(spark, sf_dir):
    return _findings("unauthenticated-industrial-protocol", View(spark, sf_dir))


_MATRIX_CELLS = """session_id, source, CASE WHEN initiator IS NULL THEN 'inferred:first-observed-sender' ELSE 'observed' END AS source_provenance,
  target, source || ' -> ' || target AS direction, initiator, CASE WHEN initiator IS NULL THEN 'not-derivable-passively' ELSE 'observed' END AS initiator_provenance,
  coalesce(label, 'tcp') AS protocol, CASE WHEN label IS NULL THEN 'observed' ELSE 'inferred:payload-shape' END AS protocol_provenance, volume_bytes, packets AS packet_count"""


@query(f"SELECT {_MATRIX_CELLS} FROM matrix")
def comm_matrix(spark, sf_dir):
    m = View(spark, sf_dir).matrix
    value = lambda *names: [F.col(f"{n}.value").alias(n) for n in names]
    marker = lambda *names: [F.col(f"{n}.provenance").alias(f"{n}_provenance") for n in names]
    return m.select(*value("session_id", "source", "target", "direction", "initiator", "protocol", "volume_bytes", "packet_count"), *marker("source", "initiator", "protocol"))


_INVENTORY = """inv AS (SELECT hosts.ip, place, CASE WHEN first_mac <> '' AND lo = hi THEN first_mac END AS mac, s_name AS oui_vendor,
    array_to_string(units, ',') AS unit_ids, CASE WHEN len(units) > 1 THEN true END AS gateway,
    CASE WHEN sent > 0 AND received > 0 THEN 'Modbus client and server' WHEN sent > 0 THEN 'Modbus client' WHEN received > 0 THEN 'Modbus server' ELSE 'undetermined' END AS role,
    CASE WHEN coalesce(sent, 0) + coalesce(received, 0) = 0 THEN 'Zero Modbus events associated with this address in this capture (requests sent: 0, requests received: 0).'
      ELSE 'Modbus requests sent by this address: ' || CAST(sent AS BIGINT) || '; Modbus requests received by this address: ' || CAST(received AS BIGINT) || '.' END AS role_evidence,
    CASE WHEN sent + received >= 3 AND (sent = 0 OR received = 0) THEN 'medium' ELSE 'low' END AS role_confidence, units
  FROM hosts LEFT JOIN asked USING (ip) LEFT JOIN supplier ON first_mac <> '' AND upper(replace(substr(first_mac, 1, 8), ':', '')) = '02' || printf('%04X', s_suppkey))"""


def _vendors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("02"), F.format_string("%04X", "s_suppkey")).alias("prefix"), F.col("s_name").alias("vendor"))


def _inventory(spark, sf_dir) -> DataFrame:
    v = View(spark, sf_dir)
    return inventory.inventory(v.segments, v.high, _vendors(spark, sf_dir))


@query(f"WITH {lens.SQL}, {_INVENTORY} SELECT ip, place, mac, oui_vendor, unit_ids, gateway, role, role_evidence, role_confidence FROM inv")
def asset_inventory(spark, sf_dir):
    rows = _inventory(spark, sf_dir)
    return rows.select(F.col("ip.value").alias("ip"), "place", F.col("mac.value").alias("mac"), F.col("oui_vendor.value").alias("oui_vendor"), F.array_join("unit_ids.value", ",").alias("unit_ids"), F.col("gateway.value").alias("gateway"), F.col("role.value").alias("role"), F.col("role_evidence.value").alias("role_evidence"), F.col("role_confidence.value").alias("role_confidence"))


@query("SELECT session_id, cycle_us, requests AS request_count FROM cycles")
def polling_cycles(spark, sf_dir):
    rows = coverage.polling_cycles(View(spark, sf_dir).high)
    return rows.select("session_id", F.round(F.col("measured_cycle_s") * 1e6).cast("long").alias("cycle_us"), "request_count")


@query("SELECT session_id, cycle_us FROM cycles WHERE cycle_us <> 0 AND (SELECT max(ts_us) - min(ts_us) FROM tcp) < 2 * cycle_us")
def coverage_warnings(spark, sf_dir):
    v = View(spark, sf_dir)
    rows = coverage.short_windows(coverage.polling_cycles(v.high), analytics.capture_summary(v.tcp, "timestamp"))
    return rows.select("session_id", F.round(F.col("measured_cycle_s") * 1e6).cast("long").alias("cycle_us"))


@query("""SELECT 'z-default' AS zone, (SELECT string_agg(DISTINCT ip, ',' ORDER BY ip) FROM visits) AS members,
  (SELECT string_agg(DISTINCT protocol, ',' ORDER BY protocol) FROM high) AS protocols""")
def zone_members(spark, sf_dir):
    v = View(spark, sf_dir)
    return analytics.zone_model(v.segments, v.high).select(F.lit("z-default").alias("zone"), F.array_join("members", ",").alias("members"), F.array_join("protocols", ",").alias("protocols"))


_ROLLUP = """SELECT section, field, sum(missing) AS count, count(*) AS total FROM (
  SELECT 'assets' AS section, unnest(['mac', 'oui_vendor', 'unit_ids', 'gateway', 'role']) AS field,
         unnest([CAST(mac IS NULL AS INT), CAST(oui_vendor IS NULL AS INT), CAST(unit_ids IS NULL OR unit_ids = '' AS INT), CAST(gateway IS NULL AS INT), CAST(role = 'undetermined' AS INT)]) AS missing FROM inv
  UNION ALL SELECT 'comm_matrix', 'initiator', CAST(initiator IS NULL AS INT) FROM matrix) GROUP BY ALL HAVING sum(missing) > 0"""


@query(f"WITH {lens.SQL}, {_INVENTORY} SELECT section, field, CAST(count AS BIGINT) AS count, total FROM ({_ROLLUP})")
def not_derivable_rollup(spark, sf_dir):
    v = View(spark, sf_dir)
    return P.not_derivable_counts(_inventory(spark, sf_dir), "assets").unionByName(P.not_derivable_counts(v.matrix, "comm_matrix"))


def _all_findings(v: View) -> DataFrame:
    """Findings of all checks with their place in the report's order."""
    parts = [spec["evaluate"](v.high).withColumns({"check_id": F.lit(name), "remediation": F.lit(spec["remediation"])}) for name, spec in sorted(definitions.CHECKS.items())]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    place = F.struct("check_id", "session_id", "packet_number", "protocol")
    return rows.withColumn("place", place)


_FOUND = """f AS (SELECT 'modbus-unauthenticated-write' AS check_id, session_id FROM high WHERE kind = 'write' AND direction = 'request'
  UNION ALL SELECT 'cleartext-protocol', session_id FROM (SELECT DISTINCT session_id, protocol FROM high WHERE protocol IN ('telnet', 'ftp', 'http'))
  UNION ALL SELECT 'unauthenticated-industrial-protocol', session_id FROM (SELECT DISTINCT session_id FROM high WHERE protocol = 'modbus-tcp'))"""


@query(f"WITH {lens.SQL}, {_FOUND} SELECT check_id, count(*) AS findings, min(session_id) AS first_session FROM f GROUP BY check_id")
def remediation_rollup(spark, sf_dir):
    rows = checks.remediations(_all_findings(View(spark, sf_dir)))
    return rows.select("place.check_id", "findings", F.col("place.session_id").alias("first_session"))


def _catalogue_sql() -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    known = ", ".join(f"({quote(e['standard'])}, {quote(e['clause'])}, {quote(e['edition'])}, {quote(e['clause_title'])})" for e in definitions.CATALOGUE)
    cited = ", ".join(f"({quote(name)}, {k}, {quote(s)}, {quote(c)})" for name, spec in definitions.CHECKS.items() for k, (s, c) in enumerate(spec["standards"]))
    return f"""WITH {lens.SQL}, k(standard, clause, edition, title) AS (VALUES {known}), c(check_id, pos, standard, clause) AS (VALUES {cited}), {_FOUND},
  t AS (SELECT check_id, string_agg(standard || ' ' || clause || ' ' || edition || ' ' || title, ' | ' ORDER BY pos) AS citations FROM c JOIN k USING (standard, clause) GROUP BY check_id)
  SELECT check_id, findings, citations FROM t JOIN (SELECT check_id, count(*) AS findings FROM f GROUP BY check_id) USING (check_id)"""


@query(_catalogue_sql())
def standards_citations(spark, sf_dir):
    """What the findings cite, once for each standard and clause, by check."""
    rows = checks.remediations(_all_findings(View(spark, sf_dir))).select("place.check_id", "findings")
    cites = {name: [{"standard": s, "clause": c} for s, c in spec["standards"] * 2] for name, spec in definitions.CHECKS.items()}
    wanted = spark.createDataFrame(list(cites.items()), "check_id string, standards array<struct<standard:string,clause:string>>")
    cited = standards.cite(rows.join(F.broadcast(wanted), "check_id"), standards.catalogue(spark, definitions.CATALOGUE), key=("check_id",))
    line = F.transform("standard_refs", lambda x: F.concat_ws(" ", x["standard"], x["clause"], x["edition"], x["clause_title"]))
    return cited.select("check_id", "findings", F.array_join(line, " | ").alias("citations"))


@query("SELECT count(*) AS packet_count, min(ts_us) AS first_us, max(ts_us) AS last_us, max(ts_us) - min(ts_us) AS window_us FROM tcp")
def capture_summary(spark, sf_dir):
    s = analytics.capture_summary(lens.events_lens(spark, sf_dir), "timestamp")
    micros = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return s.select("packet_count", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), micros("duration_s").alias("window_us"))


@query("SELECT 'modbus-rtu-over-tcp' AS protocols, 'crc16-modbus-match' AS bases, count(*) AS count FROM low HAVING count(*) > 0")
def low_confidence_summary(spark, sf_dir):
    rows = analytics.low_confidence_summary(View(spark, sf_dir).low)
    return rows.select(F.array_join("protocols", ",").alias("protocols"), F.array_join("bases", ",").alias("bases"), "count")


@query("""WITH p AS (SELECT prefix, name, row_no FROM (SELECT upper(replace(replace(raw, '-', ''), ':', '')) AS x, substr(upper(replace(replace(raw, '-', ''), ':', '')), 1, 6) AS prefix, regexp_replace(trim(name), '\\s+', ' ', 'g') AS name, row_no
  FROM (SELECT p_partkey AS row_no, substr(md5(CAST(p_partkey % 150 AS VARCHAR)), 1, 2) || '-' || CASE WHEN p_partkey % 11 = 0 THEN 'zz' ELSE '1a' END || '-' || substr(md5(CAST(p_partkey % 150 AS VARCHAR)), 3, 2) AS raw, p_name || '  ' || p_brand AS name FROM part)) WHERE regexp_matches(x, '^[0-9A-F]{6}'))
  SELECT prefix, arg_max(name, row_no) AS vendor FROM p GROUP BY prefix""")
def vendor_table(spark, sf_dir):
    digest = F.md5(F.encode((F.col("p_partkey") % 150).cast("string"), "UTF-8"))
    raw = F.concat(F.substring(digest, 1, 2), F.lit("-"), F.when(F.col("p_partkey") % 11 == 0, "zz").otherwise("1a"), F.lit("-"), F.substring(digest, 3, 2))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), raw.alias("prefix"), F.concat_ws("  ", "p_name", "p_brand").alias("vendor"))

    return build_table(rows)[0]


for _module in (textscan, records, documents):
    QUERIES.update(_module.contract_queries())
    SQL.update(_module.contract_sql())


_CELL = """'{{"provenance":"' || {p} || '","value":' || {v} || '}}'"""
_TEXT = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_MATRIX_JSON = " || ',' || ".join(
    f"""'"{name}":' || """ + _CELL.format(p=marker, v=value)
    for name, marker, value in (
        ("direction", "CASE WHEN initiator IS NULL THEN 'inferred:first-observed-sender' ELSE 'observed' END", _TEXT("source || ' -> ' || target")),
        ("initiator", "CASE WHEN initiator IS NULL THEN 'not-derivable-passively' ELSE 'observed' END", _TEXT("initiator")),
        ("packet_count", "'observed'", "packets"),
        ("protocol", "CASE WHEN label IS NULL THEN 'observed' ELSE 'inferred:payload-shape' END", _TEXT("coalesce(label, 'tcp')")),
        ("session_id", "'observed'", "session_id"),
        ("source", "CASE WHEN initiator IS NULL THEN 'inferred:first-observed-sender' ELSE 'observed' END", _TEXT("source")),
        ("target", "CASE WHEN initiator IS NULL THEN 'inferred:first-observed-sender' ELSE 'observed' END", _TEXT("target")),
        ("volume_bytes", "'observed'", "volume_bytes"),
    )
)


@query(f"""SELECT 'conversations' AS section, lpad(CAST(session_id AS VARCHAR), 20, '0') AS place,
    '{{"endpoints":["' || least(min(a), min(b)) || '","' || greatest(max(a), max(b)) || '"],"packet_count":' || count(*) || ',"session_id":' || session_id || '}}' AS row FROM seg GROUP BY session_id
  UNION ALL SELECT 'comm_matrix', lpad(CAST(first_packet AS VARCHAR), 20, '0'), '{{' || {_MATRIX_JSON} || '}}' FROM matrix JOIN sess USING (session_id)
  UNION ALL SELECT 'findings', place, '' FROM (
    SELECT 'modbus-unauthenticated-write' AS c, session_id, pn, protocol FROM high WHERE kind = 'write' AND direction = 'request'
    UNION ALL SELECT 'cleartext-protocol', session_id, min(pn), protocol FROM high WHERE protocol IN ('telnet', 'ftp', 'http') GROUP BY session_id, protocol
    UNION ALL SELECT 'unauthenticated-industrial-protocol', session_id, min(pn), 'modbus-tcp' FROM high WHERE protocol = 'modbus-tcp' GROUP BY session_id) f,
    LATERAL (SELECT c || '/' || lpad(CAST(session_id AS VARCHAR), 20, '0') || '/' || lpad(CAST(pn AS VARCHAR), 20, '0') || '/' || coalesce(f.protocol, '') AS place)""")
def json_sections(spark, sf_dir):
    """Rows of the document's JSON: conversations and the matrix whole, findings by their place."""
    from .analysis import Tables, section_rows

    v = View(spark, sf_dir)
    rows = section_rows(Tables(v.tcp, v.sessions, v.segments.drop("payload"), v.high, v.low, v.initiators, _vendors(spark, sf_dir)))
    rows = rows.filter(F.col("section").isin("conversations", "comm_matrix", "findings"))
    return rows.select("section", "place", F.when(F.col("section") == "findings", "").otherwise(F.col("row")).alias("row"))


@query()
def json_document(spark, sf_dir):
    """The whole analysis of the lens as deterministic JSON: the parts of the document, a short one in one row."""
    from .analysis import Tables, document_parts

    v = View(spark, sf_dir)
    tables = Tables(v.tcp, v.sessions, v.segments.drop("payload"), v.high, v.low, v.initiators, _vendors(spark, sf_dir))
    return document_parts(tables, lens.CAPTURE, {})


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
