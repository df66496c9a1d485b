"""The vendor table: address prefixes of six hex digits and the organisations they belong to."""

from __future__ import annotations

import csv
import io
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import mac_prefix, normalize_mac_prefix

#: Columns of the public registry's CSV file.
PREFIX_COLUMN, NAME_COLUMN = "Assignment", "Organization Name"
#: Where a vendor table is looked for; the package has none of its own.
TABLE_VARIABLE = "WIRETIDE_VENDOR_TABLE"


class VendorTableError(ValueError):
    """The vendor table is missing or a row of it is malformed."""


def parse_table(text: str, origin: str = "vendor table") -> dict[str, str]:
    """Tab-separated prefix and name; blank lines and # comments are skipped, the last of a prefix wins."""
    out: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), start=1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        parts = line.split("\t")
        if len(parts) != 2:
            raise VendorTableError(f"{origin}, row {number}: {len(parts)} columns instead of 2")
        prefix = normalize_mac_prefix(parts[0])
        if prefix is None:
            raise VendorTableError(f"{origin}, row {number}: {parts[0]!r} is no prefix")
        out[prefix] = parts[1]
    return out


def load_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(prefix, vendor) of a table file; tens of thousands of rows, which Spark broadcasts by size."""
    path = path or os.environ.get(TABLE_VARIABLE)
    if not path or not Path(path).is_file():
        raise VendorTableError(f"there is no vendor table at {path}")
    rows = sorted(parse_table(Path(path).read_text(encoding="utf-8"), path).items())
    return spark.createDataFrame(rows, "prefix string, vendor string")


def build_table(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((prefix, vendor), (skipped)): normalise rows (row_no, prefix, vendor); the last of a prefix wins."""
    name = F.trim(F.regexp_replace(F.coalesce("vendor", F.lit("")), r"\s+", " "))
    clean = rows.select("row_no", mac_prefix(F.trim("prefix")).alias("prefix"), name.alias("vendor"))
    usable = F.col("prefix").isNotNull() & (F.col("vendor") != "")
    table = clean.filter(usable).groupBy("prefix").agg(F.max_by("vendor", "row_no").alias("vendor"))
    return table, clean.agg(F.count_if(~F.coalesce(usable, F.lit(False))).alias("skipped"))


def read_registry(spark: SparkSession, text: str) -> DataFrame:
    """(row_no, prefix, vendor) of the registry's CSV text."""
    reader = csv.DictReader(io.StringIO(text))
    if not {PREFIX_COLUMN, NAME_COLUMN} <= set(reader.fieldnames or []):
        raise ValueError(f"the CSV needs the columns {PREFIX_COLUMN!r} and {NAME_COLUMN!r}")
    rows = [(k, r[PREFIX_COLUMN] or "", r[NAME_COLUMN] or "") for k, r in enumerate(reader)]
    return spark.createDataFrame(rows, "row_no long, prefix string, vendor string")


def read_registry_file(spark: SparkSession, path: str) -> DataFrame:
    """The same of the registry's CSV file, in any store that Spark reads; one task reads it, so rows keep their order."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if not {PREFIX_COLUMN, NAME_COLUMN} <= set(rows.columns):
        raise ValueError(f"the CSV needs the columns {PREFIX_COLUMN!r} and {NAME_COLUMN!r}")
    none = F.lit("")
    return rows.select(F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col(f"`{PREFIX_COLUMN}`"), none).alias("prefix"), F.coalesce(F.col(f"`{NAME_COLUMN}`"), none).alias("vendor"))


def table_text(rows: list[tuple[str, str]], source: str, date: str) -> str:
    """The table as a file: three comment lines, then prefixes in order."""
    head = [f"# Source: {source}", f"# Date: {date}", f"# Entries: {len(rows)}"]
    return "\n".join([*head, *(f"{p}\t{v}" for p, v in sorted(rows))]) + "\n"
