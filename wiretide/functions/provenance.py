"""Provenance cells: every value of an inventory or matrix says where it comes from."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The markers a cell can carry.
OBSERVED = "observed"
NOT_DERIVABLE = "not-derivable-passively"
MARKER = r"^(observed|inferred:[a-z0-9_-]+|not-derivable-passively)$"


class ProvenanceError(ValueError):
    """A field carries a value without saying where it comes from."""


def cell(value: Column, provenance: Column | str) -> Column:
    marker = F.lit(provenance) if isinstance(provenance, str) else provenance
    return F.struct(value.alias("value"), marker.alias("provenance"))


def observed(value: Column) -> Column:
    return cell(value, OBSERVED)


def inferred(value: Column, method: str) -> Column:
    marker = f"inferred:{method}"
    if not re.match(MARKER, marker):
        raise ProvenanceError(f"bad method name {method!r}")
    return cell(value, marker)


def not_derivable(kind: str) -> Column:
    return cell(F.lit(None).cast(kind), NOT_DERIVABLE)


def is_cell(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and set(kind.names) == {"value", "provenance"}


def walk(node, path: str = "") -> Iterator[tuple[str, dict]]:
    """(path, cell) of all cells of a document made of dicts and lists; a cell's own value is not entered."""
    if isinstance(node, dict) and set(node) == {"value", "provenance"}:
        yield path, node
    elif isinstance(node, (dict, list)):
        for name, child in node.items() if isinstance(node, dict) else enumerate(node):
            step = f"[{name}]" if isinstance(node, list) else f".{name}" if path else str(name)
            yield from walk(child, path + step)


def fields(kind: T.DataType, path: str = "") -> Iterator[tuple[str, bool]]:
    """(path, whether it is a cell) of all leaves of a schema; [] stands for the elements of an array."""
    if is_cell(kind):
        yield path, True
    elif isinstance(kind, T.StructType):
        for f in kind:
            yield from fields(f.dataType, f"{path}.{f.name}" if path else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from fields(kind.elementType, f"{path}[]")
    else:
        yield path, False


def _field(name: str):
    return lambda x: x[name]


def markers(df: DataFrame) -> DataFrame:
    """(path, provenance, count): how often each marker stands at each cell of a schema, however deep it lies."""
    found = []
    for path, cell in fields(df.schema):
        if cell:
            # Each array on the way is flattened, so a path leads to an array of markers.
            steps = [x for x in path.replace("[]", ".[]").split(".") if x]
            column = F.array(F.col(f"`{steps[0]}`"))
            for step in steps[1:]:
                column = F.flatten(F.filter(column, lambda x: x.isNotNull())) if step == "[]" else F.transform(column, _field(step))
            found.append(F.struct(F.lit(path).alias("path"), F.transform(column, lambda x: x["provenance"]).alias("markers")))
    rows = df.select(F.explode(F.array(*found)).alias("f")).select("f.path", F.explode("f.markers").alias("provenance"))
    return rows.groupBy("path", "provenance").agg(F.count(F.lit(1)).alias("count"))


def cells(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_cell(f.dataType)]


def assert_complete(df: DataFrame, path: str, ignore: tuple[str, ...] = ()) -> None:
    """Raise unless every leaf, however deep it lies, is a cell with a well-formed marker."""
    kept = df.drop(*ignore)
    bare = [p for p, cell in fields(kept.schema) if not cell]
    if bare:
        raise ProvenanceError(f"{path}.{bare[0]}: a value without provenance")
    if not kept.columns:
        return
    wrong = markers(kept).filter(~F.coalesce(F.col("provenance").rlike(MARKER), F.lit(False))).agg(F.min("path")).first()[0]
    if wrong:
        raise ProvenanceError(f"{path}.{wrong}: malformed provenance marker")


def not_derivable_counts(df: DataFrame, section: str) -> DataFrame:
    """(section, field, count, total): fields that some rows can't know, by name. One pass."""
    names = sorted(cells(df))
    schema = "section string, field string, count long, total long"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    sums = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(f"{c}.provenance") == NOT_DERIVABLE).alias(c) for c in names))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("count")) for c in names))
    return sums.select(F.lit(section).alias("section"), F.explode(pairs).alias("p"), "total").filter("p.count > 0").select("section", "p.field", "p.count", "total")
