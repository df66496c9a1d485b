"""Rule evaluators over events of high confidence, and the findings they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recognise import first_of

#: Severities with the risk they stand for.
RISK = {"low": "minor", "medium": "moderate", "high": "serious", "critical": "severe"}
CLEARTEXT, INDUSTRIAL = ("telnet", "ftp", "http"), ("modbus-tcp",)
UNDETERMINED = "undetermined"


def severity_to_risk(severity: str) -> str:
    if severity not in RISK:
        raise ValueError(f"unknown severity {severity!r}; known are {tuple(RISK)}")
    return RISK[severity]


def risk_of(severity):
    """The same as a column: an unknown severity fails the query."""
    table = F.create_map(*(F.lit(x) for pair in RISK.items() for x in pair))
    return F.coalesce(F.try_element_at(table, severity), F.raise_error(F.concat(F.lit("unknown severity "), severity)).cast("string"))


def _evidence(events: DataFrame) -> DataFrame:
    return events.select("capture_id", "packet_number", "session_id", "protocol")


def unauthenticated_write(events: DataFrame) -> DataFrame:
    """Every request that writes."""
    return _evidence(events.filter("kind = 'write' AND direction = 'request'"))


def cleartext_protocol(events: DataFrame) -> DataFrame:
    """The first event of each session and cleartext protocol."""
    return _evidence(first_of(events.filter(F.col("protocol").isin(*CLEARTEXT)), "session_id", "protocol"))


def industrial_protocol(events: DataFrame) -> DataFrame:
    """The first event of each session of a protocol that can't authenticate its sender."""
    return _evidence(first_of(events.filter(F.col("protocol").isin(*INDUSTRIAL)), "session_id"))


def with_parties(evidence: DataFrame, matrix: DataFrame) -> DataFrame:
    """Add the session's source and target; sessions outside the matrix have undetermined ones."""
    ends = matrix.select("capture_id", F.col("session_id.value").alias("session_id"), F.col("source.value").alias("source"), F.col("target.value").alias("target"))
    joined = evidence.join(ends, ["capture_id", "session_id"], "left")
    return joined.withColumns({"source": F.coalesce("source", F.lit(UNDETERMINED)), "target": F.coalesce("target", F.lit(UNDETERMINED))})


def remediations(findings: DataFrame) -> DataFrame:
    """(capture_id, remediation, findings): by full text, in order of first appearance of `place`."""
    return findings.groupBy("capture_id", "remediation").agg(F.count(F.lit(1)).alias("findings"), F.min("place").alias("place"))
