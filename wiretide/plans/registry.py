"""Plugin registries: dissectors (segments to events) and checks (events to findings).

A plugin is a folder with a manifest (TOML, or YAML where a YAML parser is installed) beside a Python
file. The manifest alone decides the protocol name and the confidence of what a plugin finds.
"""

from __future__ import annotations

import importlib.util
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recognise
from ..operators.checks import severity_to_risk
from ..operators.recognise import EVENT_COLUMNS
from ..operators.standards import checked
from . import plugins
from .plugins import EVENT_TYPES, PluginError

#: Confidences a manifest can state, and fields it needs.
CONFIDENCES = ("high", "low")
DISSECTOR_FIELDS = ("id", "confidence", "dissector")
CHECK_FIELDS = ("id", "title", "applies_to", "severity", "rationale", "standards", "evaluator", "remediation")

@dataclass(frozen=True)
class Dissector:
    """find takes segments and returns rows with some columns of an event."""

    id: str
    confidence: str
    find: Callable[[DataFrame], DataFrame]


def read_spec(path: Path) -> dict:
    """A TOML or YAML document as a dict."""
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".toml":
        return tomllib.loads(text)
    import yaml

    return yaml.safe_load(text)


def _checked(spec: object, fields: tuple[str, ...], path: Path) -> dict:
    if not isinstance(spec, dict):
        raise PluginError(f"{path}: not a table of fields")
    for name in fields:
        if not spec.get(name):
            raise PluginError(f"{path}: field {name!r} is missing or empty")
    return spec


def load_function(reference: str, path: Path) -> Callable:
    """`module:function` from the file of that name beside the manifest, and from nowhere else."""
    module, colon, name = str(reference).partition(":")
    if not colon or not module or not name or any(c in module for c in "/\\."):
        raise PluginError(f"{path}: {reference!r} is not of the form module:function")
    file = path.parent / f"{module}.py"
    if not file.is_file():
        raise PluginError(f"{path}: there is no file {file}")
    spec = importlib.util.spec_from_file_location(f"wiretide_plugin_{path.parent.name}_{module}", file)
    loaded = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(loaded)
    found = getattr(loaded, name, None)
    if not callable(found):
        raise PluginError(f"{path}: {file} has no function {name!r}")
    return found


def _manifests(root: Path, names: tuple[str, ...]) -> list[Path]:
    return sorted(p for n in names for p in root.rglob(n)) if root.is_dir() else []


def discover_dissectors(root: Path | str) -> list[Dissector]:
    """Dissectors of the manifests under root, in the order of their paths; a missing folder has none."""
    found: dict[str, Dissector] = {}
    for path in _manifests(Path(root), ("manifest.toml", "manifest.yaml")):
        spec = _checked(read_spec(path), DISSECTOR_FIELDS, path)
        if spec["confidence"] not in CONFIDENCES:
            raise PluginError(f"{path}: confidence {spec['confidence']!r} is none of {CONFIDENCES}")
        if spec["id"] in found:
            raise PluginError(f"{path}: the identifier {spec['id']!r} is taken")
        code = load_function(spec["dissector"], path)
        found[spec["id"]] = row_dissector(spec["id"], spec["confidence"], code) if plugins.is_row_plugin(code) else Dissector(spec["id"], spec["confidence"], code)
    return list(found.values())


def builtin_dissectors() -> list[Dissector]:
    return [Dissector(name, confidence, recognise.only(name)) for name, confidence in sorted(recognise.BUILTIN.items())]


def row_dissector(id: str, confidence: str, plugin: type) -> Dissector:
    """A plugin that takes segments one by one (see plugins) as a dissector."""
    return Dissector(id, confidence, plugins.as_find(plugins.dissector_function(id, confidence, plugin)))


def run_dissectors(segments: DataFrame, dissectors: list[Dissector] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events of high confidence, events of low confidence) of all dissectors over all segments."""
    shaped = lambda rows: rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in EVENT_TYPES.items()))
    if dissectors is None:  # the built-in ones share one pass
        table = F.create_map(*(F.lit(x) for pair in recognise.BUILTIN.items() for x in pair))
        events = shaped(recognise.events(segments).withColumn("confidence", table[F.col("protocol")]))
        return events.filter("confidence = 'high'"), events.filter("confidence = 'low'")
    parts = []
    for d in sorted(dissectors, key=lambda d: d.id):
        rows = d.find(segments)
        missing = {"packet_number", "session_id", "capture_id"} - set(rows.columns)
        if missing:
            raise PluginError(f"dissector {d.id}: events without {sorted(missing)}")
        parts.append(shaped(rows.withColumns({"protocol": F.lit(d.id), "confidence": F.lit(d.confidence)})))
    if not parts:
        schema = ", ".join(f"{c} {t}" for c, t in EVENT_TYPES.items())
        empty = segments.sparkSession.createDataFrame([], schema)
        return empty, empty
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    return events.filter("confidence = 'high'"), events.filter("confidence = 'low'")


def row_check(id: str, plugin: type) -> Callable[[DataFrame], DataFrame]:
    """A check that takes events one by one (see plugins) as an evaluator."""
    return plugins.as_find(plugins.check_function(id, plugin))


def discover_checks(root: Path | str) -> dict[str, dict]:
    """Checks of the TOML and YAML files under root, by identifier.

    evaluator is `module:name`: a function of the events' DataFrame that returns capture_id, packet_number and
    session_id of each finding, with any of the check's text fields as columns, or a class that takes events one by one.
    applies_to is kept as a note and filters nothing.
    """
    found: dict[str, dict] = {}
    for path in _manifests(Path(root), ("*.toml", "*.yaml")):
        spec = _checked(read_spec(path), CHECK_FIELDS, path)
        if spec["id"] in found:
            raise PluginError(f"{path}: the identifier {spec['id']!r} is taken")
        severity_to_risk(spec["severity"])
        refs = [(ref["standard"], ref["clause"]) for ref in spec["standards"]]
        code = load_function(spec["evaluator"], path)
        found[spec["id"]] = {**spec, "standards": refs, "evaluate": row_check(spec["id"], code) if plugins.is_row_plugin(code) else code}
    return found


def load_catalogue(root: Path | str) -> list[dict]:
    """Entries of all `catalog` files under root, each checked."""
    out = []
    for path in _manifests(Path(root), ("catalog.toml", "catalog.yaml")):
        entries = (read_spec(path) or {}).get("entries")
        if not isinstance(entries, list):
            raise PluginError(f"{path}: there is no list of entries")
        out += [checked(e, str(path)) for e in entries]
    return out


__all__ = ["EVENT_COLUMNS", "Dissector", "PluginError", "builtin_dissectors", "discover_checks", "discover_dissectors", "load_catalogue", "load_function", "read_spec", "row_check", "row_dissector", "run_dissectors"]
