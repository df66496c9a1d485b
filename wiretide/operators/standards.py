"""The catalogue of standards' clauses and its join with findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an entry with their types, and where a clause's title can come from.
FIELDS = {"standard": str, "edition": str, "clause": str, "clause_title": str, "clause_title_source": str, "paraphrase": str, "verified": bool}
TITLE_SOURCES = ("own", "copy")


class CatalogueError(ValueError):
    """An entry is malformed, or a citation names a clause that no catalogue has."""


def checked(entry: dict, origin: str) -> dict:
    """An entry of the right types: an exact type each, and only a copy's title is verified."""
    for name, kind in FIELDS.items():
        if type(entry.get(name)) is not kind or entry[name] == "":
            raise CatalogueError(f"{origin}: field {name!r} must be a non-empty {kind.__name__}")
    if entry["clause_title_source"] not in TITLE_SOURCES:
        raise CatalogueError(f"{origin}: clause_title_source is none of {TITLE_SOURCES}")
    if entry["verified"] and entry["clause_title_source"] != "copy":
        raise CatalogueError(f"{origin}: a verified entry has its title from a copy")
    return {**{k: entry[k] for k in FIELDS}, "verification_note": entry.get("verification_note") or ""}


def catalogue(spark: SparkSession, entries: list[dict], origin: str = "catalogue") -> DataFrame:
    rows = [checked(e, origin) for e in entries]
    kinds = ", ".join(f"{k} {'boolean' if t is bool else 'string'}" for k, t in FIELDS.items())
    return spark.createDataFrame(rows, kinds + ", verification_note string")


def cite(findings: DataFrame, known: DataFrame, refs: str = "standards", key: tuple[str, ...] = ("finding_id",)) -> DataFrame:
    """Replace an array of (standard, clause) by the catalogue's entries, in the same order.

    Repeated citations of a finding count once, the first. A clause that the catalogue lacks fails
    the query. The catalogue is small by nature; Spark broadcasts it by its size.
    """
    flat = findings.select(*key, F.posexplode(refs).alias("pos", "ref"))
    flat = flat.groupBy(*key, F.col("ref.standard").alias("standard"), F.col("ref.clause").alias("clause")).agg(F.min("pos").alias("pos"))
    joined = flat.join(known, ["standard", "clause"], "left")
    entry = F.struct("standard", "edition", "clause", "clause_title", "clause_title_source", "paraphrase", "verified", "verification_note")
    missing = F.raise_error(F.concat(F.lit("no catalogue entry for "), F.col("standard"), F.lit(" "), F.col("clause")))
    found = F.when(F.col("edition").isNull(), missing.cast(known.select(entry).schema[0].dataType)).otherwise(entry)
    cited = joined.select(*key, "pos", found.alias("entry")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("standard_refs"))
    return findings.join(cited, list(key), "left")
