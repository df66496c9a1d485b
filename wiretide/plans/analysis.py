"""The whole analysis of a capture as one document."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import provenance as P
from ..operators import analytics, checks, coverage, decode, inventory, standards
from ..operators.recognise import EVENT_COLUMNS
from ..session import cut
from ..sources import capture as C
from ..sources import vendors as V
from . import definitions
from .registry import Dissector, run_dissectors
from .report import dump

#: Identifiers and versions in the document.
ZONE_ID, CONDUIT_ID, RUBRIC = "z-default", "c-default", "1.0"
ZONE_NAME = "Default zone (undifferentiated, provisional)"
ZONE_NOTE = "Filled from the capture alone; the network's real division into zones is not known."
CONDUIT_NOTE = "Seen in this capture's traffic, not taken from a network design."
METHOD_NOTE = "Severities follow the written criteria of the rubric."
#: Begins a place of the frame that entries fill; no text of a document has it.
HOLE = "\ue000"
LIMITS = (
    "Absence proves nothing: hosts that talked elsewhere, or kept silent, are in none of these tables.",
    "A row is an address. Behind one address there can be several machines (gateways, address translation), and one machine can have several.",
)


@dataclass
class Tables:
    """The frames that an analysis is made of."""

    tcp: DataFrame
    sessions: DataFrame
    segments: DataFrame
    high: DataFrame
    low: DataFrame
    initiators: DataFrame
    vendors: DataFrame | None


@dataclass
class Result:
    analysis: dict
    warnings: tuple[str, ...] = ()
    tables: Tables | None = field(default=None, repr=False)


def tables(packets: DataFrame, vendors: DataFrame | None = None, dissectors: list[Dissector] | None = None, trailer_is_payload: bool = True) -> Tables:
    """All frames from packets of one or many captures; nothing runs yet."""
    tcp = decode.tcp_packets(packets, trailer_is_payload)
    sessions = decode.sessions(tcp)
    segments = decode.segments(tcp, sessions)
    high, low = run_dissectors(segments, dissectors)
    return Tables(tcp, sessions, segments, high, low, decode.initiators(tcp, sessions), vendors)


def findings(t: Tables, matrix: DataFrame, specs: dict | None = None, known: DataFrame | None = None) -> DataFrame:
    """Findings of all checks with risk, parties and cited clauses, in columns of the document.

    A check's evaluator may return columns of its metadata, which then win over the definition where
    they aren't null.
    """
    spark = t.high.sparkSession
    specs = definitions.CHECKS if specs is None else specs
    known = standards.catalogue(spark, definitions.CATALOGUE) if known is None else known
    parts = []
    for name, spec in sorted(specs.items()):
        rows = spec["evaluate"](t.high)
        refs = F.array(*(F.struct(F.lit(s).alias("standard"), F.lit(c).alias("clause")) for s, c in spec["standards"]))
        own = {"check_id": F.lit(name), "standards": refs, **{k: F.lit(spec[k]) for k in ("title", "severity", "rationale", "remediation")}}
        said = {k: F.coalesce(F.col(k), v) if k in rows.columns else v for k, v in own.items()}
        protocol = {} if "protocol" in rows.columns else {"protocol": F.lit(None).cast("string")}
        rows = rows.withColumns({**said, **protocol})
        parts.append(rows.select("capture_id", "packet_number", "session_id", "protocol", *own))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = checks.with_parties(rows, matrix).withColumn("risk", checks.risk_of(F.col("severity")))
    # Citations depend on the check alone, so the catalogue is joined once a check, not once a finding.
    cited = standards.cite(rows.select("check_id", "standards").distinct(), known, key=("check_id",)).select("check_id", "standard_refs")
    return rows.drop("standards").join(cited, "check_id")


def _cells(row) -> dict:
    return {k: {"value": v["value"], "provenance": v["provenance"]} for k, v in row.items()}


def document(t: Tables, capture_id: str, capture: dict, specs: dict | None = None, known: DataFrame | None = None) -> Result:
    """Run the analysis of one capture and put it together on the driver; results are small by then."""
    one = lambda df: df.filter(F.col("capture_id") == capture_id)
    events = [r.asDict(True) for r in one(t.high).select(*EVENT_COLUMNS).orderBy("packet_number", "session_id", "protocol").collect()]
    weak = [r.asDict(True) for r in one(t.low).select(*EVENT_COLUMNS).orderBy("packet_number", "session_id", "protocol").collect()]
    plain = lambda e: {k: v for k, v in e.items() if v is not None and k != "capture_id"}
    talks = one(analytics.conversations(t.segments)).orderBy("session_id").collect()
    matrix = one(analytics.matrix(t.tcp, t.sessions, t.segments, t.high, t.low, t.initiators))
    P.assert_complete(matrix, "comm_matrix", ("capture_id", "first_packet"))
    rows = matrix.orderBy("first_packet").drop("capture_id", "first_packet").collect()
    hosts = one(inventory.inventory(t.segments, t.high, t.vendors))
    P.assert_complete(hosts, "assets", ("capture_id", "place"))
    assets = hosts.orderBy("place").drop("capture_id", "place").collect()
    cycles = one(coverage.polling_cycles(t.high)).orderBy("session_id").collect()
    found = one(findings(t, matrix, specs, known)).orderBy("check_id", "session_id", "packet_number", "protocol").collect()
    summary = one(analytics.capture_summary(t.tcp, "timestamp")).first() if "first_seen" not in capture else None
    first, last = (capture["first_seen"], capture["last_seen"]) if summary is None and "first_seen" in capture else (summary.first_seen, summary.last_seen) if summary else (None, None)
    window = round(last - first, 6) if first is not None else None
    quiet = one(decode.payloadless(t.tcp, t.sessions)).count()
    members = sorted({e for r in assets for e in [r.ip["value"]]})
    analysis = {
        "capture": capture,
        "conversations": [{"session_id": r.session_id, "endpoints": list(r.endpoints), "packet_count": r.packet_count} for r in talks],
        "protocol_events": [plain(e) for e in events],
        "low_confidence_events": [plain(e) for e in weak],
        "zones": [{"id": ZONE_ID, "name": ZONE_NAME, "members": members, "provisional": True, "note": ZONE_NOTE}],
        "conduits": [{"id": CONDUIT_ID, "zones": [ZONE_ID], "protocols": sorted({e["protocol"] for e in events}), "provisional": True, "note": CONDUIT_NOTE}],
        "findings": [_finding(r.asDict(True)) for r in found],
        "methodology": {"rubric_version": RUBRIC, "note": METHOD_NOTE},
        "assets": [_cells(r.asDict(True)) for r in assets],
        "coverage": {"window_duration_s": window, "window_multiplier_threshold": coverage.MULTIPLIER, "polling_cycles": [{"session_id": r.session_id, "measured_cycle_s": r.measured_cycle_s, "request_count": r.request_count} for r in cycles]},
        "comm_matrix": [_cells(r.asDict(True)) for r in rows],
    }
    return Result(analysis, tuple(_warnings(analysis, window, quiet, t.vendors is not None)), t)


def _finding(row: dict) -> dict:
    keep = ("check_id", "title", "severity", "risk", "rationale", "standard_refs", "remediation")
    return {**{k: row[k] for k in keep}, "evidence": {k: row[k] for k in ("packet_number", "session_id", "source", "target")}}


def _warnings(a: dict, window: float | None, quiet: int, has_vendors: bool) -> list[str]:
    """What a reader must know about this run: of the notes below, in their order, those that hold."""
    capture, weak, cycles = a["capture"], a["low_confidence_events"], a["coverage"]["polling_cycles"]
    empty, short = capture.get("packet_count") == 0, capture.get("snaplen_truncated_packet_count") or 0
    brief = [c for c in cycles if window is not None and c["measured_cycle_s"] and window < coverage.MULTIPLIER * c["measured_cycle_s"]]
    names, bases = (", ".join(sorted({e[k] or "-" for e in weak})) for k in ("protocol", "basis"))
    notes = [
        (empty, "The capture is well formed and has no packets: that nothing was found says nothing."),
        (not empty and not a["protocol_events"], "Packets, but no known application: no payload had the shape of a protocol that this package recognises."),
        (short, f"Frames cut by the snap length ({capture.get('snaplen')} bytes): cut {short} of {capture.get('packet_count')} frames, from number {capture.get('snaplen_truncated_first_packet_number')} on. Protocols in the missing bytes go unseen."),
        (weak, f"Weakly recognised, and so in no finding: {len(weak)} event(s), {names} by {bases}. Random bytes pass such a test now and then."),
        *((True, f"Session {c['session_id']} may poll every {c['measured_cycle_s']} seconds, but {window} seconds of capture hold fewer than {coverage.MULTIPLIER:g} such intervals.") for c in brief),
        (not has_vendors, "No vendor table was given, so the vendor of every host is open."),
        (True, f"Numbers of this run: {len(a['assets'])} addresses; {len(a['comm_matrix'])} sessions with payload and {quiet} without; seconds from first to last packet: {'unknown' if window is None else window}."),
        *((True, limit) for limit in LIMITS),
        (quiet, f"Sessions without any payload, counted here and listed nowhere: {quiet}."),
    ]
    return [text for holds, text in notes if holds]


def _sorted_keys(value, kind: T.DataType):
    """A column whose structures, however deep, have their fields in the order of their names."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_sorted_keys(value[n], kind[n].dataType).alias(n) for n in sorted(kind.names))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_keys(x, kind.elementType))
    return value


def section_rows(t: Tables, specs: dict | None = None) -> DataFrame:
    """(capture_id, section, place, row): the entries of the documents of all captures as JSON, made by the workers.

    place orders a section's rows; keys are sorted, and only events leave out what is null.
    """
    matrix = analytics.matrix(t.tcp, t.sessions, t.segments, t.high, t.low, t.initiators)
    found = findings(t, matrix, specs)
    evidence = F.struct("packet_number", "session_id", "source", "target").alias("evidence")
    keep = ["check_id", "title", "severity", "risk", "rationale", "standard_refs", "remediation"]
    parts = {
        "conversations": (analytics.conversations(t.segments).select("capture_id", "session_id", "endpoints", "packet_count"), ["session_id"]),
        "protocol_events": (t.high.select(*EVENT_COLUMNS), ["packet_number", "session_id", "protocol"]),
        "low_confidence_events": (t.low.select(*EVENT_COLUMNS), ["packet_number", "session_id", "protocol"]),
        "polling_cycles": (coverage.polling_cycles(t.high), ["session_id"]),
        "comm_matrix": (matrix, ["first_packet"]),
        "assets": (inventory.inventory(t.segments, t.high, t.vendors), ["place"]),
        "findings": (found.select("capture_id", "session_id", "packet_number", "protocol", evidence, *keep), ["check_id", "session_id", "packet_number", "protocol"]),
    }
    out = None
    for name, (rows, order) in parts.items():
        hidden = {"capture_id", *(c for c in order if name in ("comm_matrix", "assets")), *(("session_id", "packet_number", "protocol") if name == "findings" else ())}
        shown = F.struct(*(_sorted_keys(F.col(c), rows.schema[c].dataType).alias(c) for c in sorted(rows.columns) if c not in hidden))
        numbers = {c for c in order if not isinstance(rows.schema[c].dataType, T.StringType)}
        place = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 20, "0") if c in numbers else F.coalesce(F.col(c), F.lit("")) for c in order))
        part = rows.select("capture_id", F.lit(name).alias("section"), place.alias("place"), F.to_json(shown, {"ignoreNullFields": str("events" in name).lower()}).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def write_sections(t: Tables, folder: str, specs: dict | None = None) -> None:
    """Write the entries of all captures' documents, a folder for each capture and section; the driver sees none of them."""
    section_rows(t, specs).write.partitionBy("capture_id", "section").json(folder)


#: Entries of a part of a document, some more or fewer as the range's bounds are estimates.
PART = 10_000


def document_parts(t: Tables, capture_id: str, capture: dict, specs: dict | None = None, size: int = PART) -> DataFrame:
    """(part, analysis): the document of one capture as JSON, in parts of some `size` entries that the workers make.

    Joined in the order of part they are the bytes of report.dump(document(...).analysis); a document of at
    most `size` entries is one row. The driver holds the frame around the entries, and none of them.
    """
    one = lambda df: df.filter(F.col("capture_id") == capture_id)
    P.assert_complete(one(analytics.matrix(t.tcp, t.sessions, t.segments, t.high, t.low, t.initiators)), "comm_matrix", ("capture_id", "first_packet"))
    hosts = one(inventory.inventory(t.segments, t.high, t.vendors))
    P.assert_complete(hosts, "assets", ("capture_id", "place"))
    if "first_seen" in capture:
        first, last = capture["first_seen"], capture["last_seen"]
    else:
        summary = one(analytics.capture_summary(t.tcp, "timestamp")).first()
        first, last = (summary.first_seen, summary.last_seen) if summary else (None, None)
    protocols = sorted(r.protocol for r in one(t.high).select("protocol").distinct().collect())
    frame = {
        "capture": capture,
        **{name: [_hole(name)] for name in ("conversations", "protocol_events", "low_confidence_events", "findings", "assets", "comm_matrix")},
        "zones": [{"id": ZONE_ID, "name": ZONE_NAME, "members": [_hole("members")], "provisional": True, "note": ZONE_NOTE}],
        "conduits": [{"id": CONDUIT_ID, "zones": [ZONE_ID], "protocols": protocols, "provisional": True, "note": CONDUIT_NOTE}],
        "methodology": {"rubric_version": RUBRIC, "note": METHOD_NOTE},
        "coverage": {"window_duration_s": round(last - first, 6) if first is not None else None, "window_multiplier_threshold": coverage.MULTIPLIER, "polling_cycles": [_hole("polling_cycles")]},
    }
    # Texts of the frame and names of sections, in turn.
    around = re.split(f'"{HOLE}(\\w+)"', dump(frame))
    at = F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(around) if k % 2 for x in (name, k))), F.col("section"))
    spoken = F.pandas_udf(lambda rows: rows.map(lambda row: dump(json.loads(row))), "string")
    rows = one(section_rows(t, specs)).select("section", "place", "row")
    fractions = F.col("section").isin("polling_cycles", "protocol_events", "low_confidence_events")
    # Numbers with a fraction are written as Python writes them.
    rows = rows.filter(~fractions).unionByName(rows.filter(fractions).withColumn("row", spoken("row")))
    members = hosts.select(F.lit("members").alias("section"), F.col("ip.value").alias("place")).distinct().withColumn("row", F.concat(F.lit('"'), "place", F.lit('"')))
    entries = rows.unionByName(members).select(at.alias("at"), F.split("place", "/", 4).alias("place"), "row")
    texts = entries.sparkSession.createDataFrame([(k, [], text) for k, text in enumerate(around) if k % 2 == 0], "at int, place array<string>, row string")
    order = ["at", "place", "row", "id"]
    pieces = cut(entries.unionByName(texts).withColumn("id", F.monotonically_increasing_id()), "document-pieces")
    heads = pieces.groupBy("at").agg(F.min(F.struct("place", "row", "id")).getField("id").alias("id"), F.count(F.lit(1)).alias("n")).collect()
    head = F.col("id").isin([r.id for r in heads])
    told = pieces.select(*order, F.when(head, F.col("row")).otherwise(F.concat(F.lit(","), "row")).alias("text"))
    ranges = told.repartitionByRange(-(-sum(r.n for r in heads) // (size + len(around))), *order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for batch in batches for x in batch.column(1).to_pylist()]
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array(["".join(texts)], pa.string())], names=["part", "analysis"])

    # The order of a task's rows is that of the sort, on which the columns that it read have no bearing.
    return ranges.select("at", "text").mapInArrow(joined, "part long, analysis string")


def _hole(name: str) -> str:
    return HOLE + name


def capture_section(row: dict, first_seen: float | None, last_seen: float | None) -> dict:
    """The capture's part of the document, from its row of the audit."""
    told = ("sha256", "packet_count", "snaplen", "snaplen_note", "snaplen_truncated_packet_count", "snaplen_truncated_first_packet_number")
    return {"filename": row["capture_id"], "first_seen": first_seen, "last_seen": last_seen, **{k: row[k] for k in told}}


def audited(spark: SparkSession, files: list[tuple[str, int]]) -> dict[str, dict]:
    """Rows of the audit by file name; the first damaged file raises its error."""
    rows = {r.capture_id: r.asDict() for r in C.audit_files(spark, files).collect()}
    for path, _ in files:
        row = rows[path.rsplit("/", 1)[-1]]
        if row["error"]:
            raise C.ERRORS[row["error"]](row["message"])
    return rows


def analyze_all(spark: SparkSession, paths: list[str | Path], vendor_table: str | None = None, dissectors: list[Dissector] | None = None, specs: dict | None = None, trailer_is_payload: bool = True) -> dict[str, Result]:
    """Audit capture files (or those of folders), then analyse them together; results by file name, so names must differ.

    Files are audited a task each, and damaged ones raise before anything else happens. One job decodes
    all captures.
    """
    files = [x for given in paths for x in C.list_files(spark, str(given))]
    if len({p.rsplit("/", 1)[-1] for p, _ in files}) < len(files):
        raise ValueError("capture files of the same name can't be analysed together")
    audits = audited(spark, files)
    try:
        vendors = V.load_table(spark, vendor_table)
    except V.VendorTableError:
        if vendor_table is not None:
            raise
        vendors = None
    packets = C.read_captures(spark, paths)
    times = {r.capture_id: (r.first_seen, r.last_seen) for r in analytics.capture_summary(packets).collect()}
    t = tables(packets, vendors, dissectors, trailer_is_payload)
    # A dozen results come from these frames. Payloads end here: nothing later may show them.
    t.tcp = cut(t.tcp, "tcp")
    t.sessions = cut(decode.sessions(t.tcp), "sessions")
    t.segments = cut(decode.segments(t.tcp, t.sessions), "segments")
    high, low = run_dissectors(t.segments, dissectors)
    events = cut(high.unionByName(low), "events")
    t.high, t.low = events.filter("confidence = 'high'"), events.filter("confidence = 'low'")
    t.segments, t.tcp = t.segments.drop("payload"), t.tcp.drop("payload")
    t.initiators = cut(decode.initiators(t.tcp, t.sessions), "initiators")
    return {name: document(t, name, capture_section(row, *times.get(name, (None, None))), specs) for name, row in audits.items()}


def analyze(spark: SparkSession, path: str | Path, **options) -> Result:
    """Analyse one capture file; options as for analyze_all."""
    return analyze_all(spark, [path], **options)[Path(path).name]
