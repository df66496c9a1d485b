"""Plugins in plain Python as table functions, which take rows one by one and keep what they need.

A dissector is a class with segment(row), which yields events, and a check one with event(row), which
yields findings; end(), if there is one, yields what is left when the rows of a partition are over. Spark
partitions and sorts the rows (by session and packet number for segments, by capture for events, or by
the plugin's own `by`), so a plugin holds its own state and nothing else, however long a capture is.

The functions can be called from SQL by their registered names, as in
SELECT * FROM my_plugin(TABLE(segments)).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

EVENT_TYPES = {
    "capture_id": "string",
    "packet_number": "long",
    "session_id": "long",
    "protocol": "string",
    "confidence": "string",
    "direction": "string",
    "src_ip": "string",
    "dst_ip": "string",
    "timestamp": "double",
    "unit_id": "int",
    "transaction_id": "int",
    "function_code": "int",
    "function_name": "string",
    "kind": "string",
    "basis": "string",
    "is_exception": "boolean",
}
FINDING_TEXTS = ("title", "severity", "rationale", "remediation")
FINDING_TYPES = {"capture_id": "string", "packet_number": "long", "session_id": "long", **dict.fromkeys(FINDING_TEXTS, "string")}


class PluginError(ValueError):
    """A plugin's manifest, file or output is malformed."""


def is_row_plugin(found: object) -> bool:
    """Whether a manifest names a class that takes rows, and not a function of DataFrames."""
    return isinstance(found, type) and (hasattr(found, "segment") or hasattr(found, "event"))


def _function(plugin: type, method: str, types: dict[str, str], needed: set[str], by: tuple[str, ...], order: tuple[str, ...], shape: Callable[[dict, dict], tuple]):
    """A table function that gives each partition an instance of the plugin."""
    # No DDL: analyze runs where there is no session to parse it.
    kinds = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}
    schema = StructType([StructField(c, kinds[t]) for c, t in types.items()])
    label = plugin.__name__
    by = tuple(getattr(plugin, "by", by))

    class Found:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise PluginError(f"{label} takes a table")
            if missing := (needed | set(by)) - set(rows.dataType.fieldNames()):
                raise PluginError(f"{label} needs the columns {sorted(missing)}")
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(c) for c in by], orderBy=[OrderingColumn(c) for c in order])

        def __init__(self):
            self.plugin, self.row = plugin(), {}

        def eval(self, rows: Row) -> Iterator[tuple]:
            self.row = rows.asDict()
            for found in getattr(self.plugin, method)(self.row) or ():
                yield shape(self.row, found)

        def terminate(self) -> Iterator[tuple]:
            for found in (self.plugin.end() or ()) if hasattr(self.plugin, "end") else ():
                yield shape(self.row, found)

    return udtf(Found)


def dissector_function(id: str, confidence: str, plugin: type):
    """The table function of a dissector: segments (rows of operators.decode.segments) to events."""

    def shape(row: dict, event: dict) -> tuple:
        if "packet_number" not in event or "session_id" not in event:
            raise PluginError(f"dissector {id}: an event without packet_number or session_id")
        if event.get("protocol") not in (None, id):
            raise PluginError(f"dissector {id}: an event of protocol {event['protocol']!r}")
        fixed = {"capture_id": row["capture_id"], "protocol": id, "confidence": confidence}
        return tuple((event | fixed).get(c) for c in EVENT_TYPES)

    return _function(plugin, "segment", EVENT_TYPES, {"capture_id", "session_id", "packet_number"}, ("capture_id", "session_id"), ("packet_number",), shape)


def check_function(id: str, plugin: type):
    """The table function of a check: events to findings (evidence, and texts that win over the manifest's)."""

    def shape(row: dict, finding: dict) -> tuple:
        evidence = finding.get("evidence") or {}
        if "packet_number" not in evidence or "session_id" not in evidence:
            raise PluginError(f"check {id}: a finding without packet_number or session_id")
        return row["capture_id"], evidence["packet_number"], evidence["session_id"], *(finding.get(c) for c in FINDING_TEXTS)

    return _function(plugin, "event", FINDING_TYPES, {"capture_id", "packet_number"}, ("capture_id",), ("packet_number", "session_id", "protocol"), shape)


def as_find(function) -> Callable[[DataFrame], DataFrame]:
    """A table function as a function of DataFrames."""
    return lambda rows: function(rows.asTable())


def sql_name(id: str) -> str:
    return re.sub(r"\W", "_", id.lower())


def register(spark: SparkSession, id: str, function) -> str:
    """Make a table function known to SQL; returns its name there."""
    spark.udtf.register(sql_name(id), function)
    return sql_name(id)


class Turns:
    """A dissector that tells how a session's sides take turns.

    An event marks the last segment of each turn, and its transaction_id is how many segments the turn had.
    """

    def __init__(self):
        self.last, self.count = None, 0

    def segment(self, row: dict) -> Iterator[dict]:
        side = row["src_ip"], row["src_port"]
        if self.last and (self.last["src_ip"], self.last["src_port"]) != side:
            yield self.ended()
            self.count = 0
        self.last, self.count = {k: row[k] for k in ("packet_number", "session_id", "src_ip", "src_port", "dst_ip", "timestamp")}, self.count + 1

    def ended(self) -> dict:
        return {k: v for k, v in self.last.items() if k != "src_port"} | {"basis": "turn", "transaction_id": self.count}

    def end(self) -> Iterator[dict]:
        if self.last:
            yield self.ended()
