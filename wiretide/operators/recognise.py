"""Protocol recognition by the shape of a payload, never by a port number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.octets import crc16, size, u8, u16

#: Function codes of the Modbus application protocol, with what they do and their names.
FUNCTION_CODES = {
    1: ("read", "Read Coils"),
    2: ("read", "Read Discrete Inputs"),
    3: ("read", "Read Holding Registers"),
    4: ("read", "Read Input Registers"),
    5: ("write", "Write Single Coil"),
    6: ("write", "Write Single Register"),
    7: ("read", "Read Exception Status"),
    8: ("other", "Diagnostics"),
    11: ("read", "Get Comm Event Counter"),
    12: ("read", "Get Comm Event Log"),
    15: ("write", "Write Multiple Coils"),
    16: ("write", "Write Multiple Registers"),
    17: ("read", "Report Slave Id"),
    20: ("read", "Read File Record"),
    21: ("write", "Write File Record"),
    22: ("write", "Mask Write Register"),
    23: ("write", "Read/Write Multiple Registers"),
    24: ("read", "Read FIFO Queue"),
    43: ("read", "Read Device Identification"),
}
#: Control verbs and request methods.
FTP_VERBS = ["USER", "PASS", "RETR", "STOR", "LIST", "QUIT", "PWD", "CWD", "TYPE", "PORT", "PASV"]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS"]

#: Columns of an event of any protocol; what a protocol doesn't know is null.
EVENT_COLUMNS = ["capture_id", "packet_number", "session_id", "protocol", "confidence", "direction", "src_ip", "dst_ip", "timestamp", "unit_id", "transaction_id", "function_code", "function_name", "kind", "basis", "is_exception"]


def _known(part: int, code: Column, default: str) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in FUNCTION_CODES.items() for x in (k, v[part])))
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def mbap_valid(h: Column) -> Column:
    """An MBAP header whose length is exactly the rest of the payload."""
    return F.when(size(h) < 8, False).otherwise((u16(h, 2) == 0) & (u16(h, 4) == size(h) - 6))


def rtu_valid(h: Column) -> Column:
    """A serial-line frame: address, known function, right checksum (low byte first)."""
    n = size(h)
    address, code = u8(h, 0), u8(h, 1).bitwiseAND(F.lit(0x7F))
    last = F.substring(h, n * 2 - 3, F.lit(4))
    sent = F.conv(F.concat(F.substring(last, 3, 2), F.substring(last, 1, 2)), 16, 10).cast("int")
    plausible = (n >= 4) & address.between(1, 247) & code.isin(list(FUNCTION_CODES))
    return F.when(~F.coalesce(plausible, F.lit(False)), False).otherwise(crc16(h, F.greatest(n - 2, F.lit(1))) == sent)


def telnet_basis(h: Column) -> Column:
    return F.when((size(h) >= 3) & F.substring(h, 1, 4).isin("FFFA", "FFFB", "FFFC", "FFFD", "FFFE"), F.lit("telnet-iac-negotiation"))


def ftp_basis(text: Column) -> Column:
    """text: the payload, each byte a character."""
    verb = text.rlike(r"\A(?:" + "|".join(FTP_VERBS) + r")[ \r]")
    return F.when(F.length(text) < 4, None).when(verb, "ftp-control-verb").when(text.rlike(r"\A[0-9]{3}[ -]"), "ftp-reply-code")


def http_basis(text: Column) -> Column:
    line = F.substring_index(F.substring(text, 1, 256), "\n", 1)
    request = text.rlike(r"\A(?:" + "|".join(HTTP_METHODS) + ") ") & (line.contains("HTTP/1.0") | line.contains("HTTP/1.1"))
    return F.when(F.length(text) < 14, None).when(request, "http-request-line").when(text.rlike(r"\AHTTP/1\.[01] [0-9]{3}"), "http-status-line")


def with_direction(events: DataFrame) -> DataFrame:
    """Whoever sends a session's first recognised payload is its client; what it sends are requests.

    Each protocol has its own view of a session. The first sender is found by aggregation and joined,
    so a session with most packets is aggregated in parts.
    """
    key = ["capture_id", "session_id", "protocol"]
    first = events.groupBy(*key).agg(F.min_by(F.struct("src_ip", "src_port"), "packet_number").alias("client"))
    client = (F.col("src_ip") == F.col("client.src_ip")) & (F.col("src_port") == F.col("client.src_port"))
    return events.join(first, key).withColumn("direction", F.when(client, "request").otherwise("response")).drop("client")


#: The built-in recognisers with the confidence of what they find.
BUILTIN = {"ftp": "high", "http": "high", "modbus-rtu-over-tcp": "low", "modbus-tcp": "high", "telnet": "high"}


def _found(protocol: str, **values: Column) -> Column:
    """What a recogniser says of a payload, in one shape for all protocols."""
    kinds = {"unit_id": "int", "transaction_id": "int", "function_code": "int", "function_name": "string", "kind": "string", "basis": "string", "is_exception": "boolean"}
    return F.struct(F.lit(protocol).alias("protocol"), *(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def recognisers(h: Column, text: Column) -> dict[str, Column]:
    """For each protocol what it finds in a payload, or null. h: hex, text: bytes as characters."""
    code = u8(h, 7)
    serial = u8(h, 1).bitwiseAND(F.lit(0x7F))
    named = lambda c: {"function_code": c, "function_name": _known(1, c, "Unknown"), "kind": _known(0, c, "unknown")}
    said = lambda protocol, basis: F.when(basis.isNotNull(), _found(protocol, basis=basis))
    return {
        "modbus-tcp": F.when(mbap_valid(h), _found("modbus-tcp", unit_id=u8(h, 6), transaction_id=u16(h, 0), **named(code))),
        "modbus-rtu-over-tcp": F.when(~mbap_valid(h) & rtu_valid(h), _found("modbus-rtu-over-tcp", unit_id=u8(h, 0), basis=F.lit("crc16-modbus-match"), is_exception=u8(h, 1) >= 128, **named(serial))),
        "telnet": said("telnet", telnet_basis(h)),
        "ftp": said("ftp", ftp_basis(text)),
        "http": said("http", http_basis(text)),
    }


def events(segments: DataFrame, *protocols: str) -> DataFrame:
    """Events of some or all built-in protocols: one pass over the payloads, whatever their number.

    No rule but the checksum looks beyond the first 300 bytes. A protocol without directions has null.
    """
    names = list(protocols or BUILTIN)
    rows = segments.withColumns({"__h": F.hex("payload"), "__text": F.decode(F.substring("payload", 1, 300), "ISO-8859-1")}).drop("payload")
    all_of = recognisers(F.col("__h"), F.col("__text"))
    seen = F.filter(F.array(*(all_of[n] for n in names)), lambda x: x.isNotNull())
    found = rows.select(*[c for c in rows.columns if c not in ("__h", "__text")], F.explode(seen).alias("__e")).select("*", "__e.*").drop("__e")
    directed = with_direction(found)
    return directed.withColumn("direction", F.when(F.col("protocol") != "modbus-rtu-over-tcp", F.col("direction"))) if "modbus-rtu-over-tcp" in names else directed


def only(protocol: str):
    """A recogniser of one protocol, as a dissector plugin takes it."""
    return lambda segments: events(segments, protocol)


def first_of(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each group, by file order; a group with most events is aggregated in parts."""
    by = ["capture_id", *keys]
    rest = [c for c in events.columns if c not in by]
    first = events.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("packet_number", *(c for c in ("session_id", "protocol") if c in rest))).alias("first"))
    return first.select(*by, "first.*").select(*events.columns)
