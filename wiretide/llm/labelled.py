"""Bounded samples of labelled documents for the trained classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most: those of the smallest hash of their id.
SAMPLE_ROWS = 12_000


def remainder(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, learnt: Column, id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, y): at most `rows` rows of documents with a label for which `learnt` (of the labels' id) holds.

    Null labels and null ids are left out; null text is empty. Where labels or ids repeat, every
    different triple counts against the bound, and once. The broadcast sides have at most `rows` rows
    of numbers, so their size is bounded whatever the tables are. Further columns of any name don't matter.
    """
    chosen = labels.filter(learnt & F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("chosen"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("chosen"), "chosen", "y").limit(rows)
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    pairs = given.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).select("id", "digest", "y").distinct()
    picked = pairs.orderBy(F.xxhash64("id"), "id", "digest", "y").limit(rows).select(F.col("id").alias("i"), F.col("digest").alias("d"), "y")
    found = given.join(F.broadcast(picked), (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")))
    return found.groupBy("id", "digest", "y").agg(F.first("text").alias("text")).select("id", "text", "y")
