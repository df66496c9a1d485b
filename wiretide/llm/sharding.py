"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorted by fractional rank, every
stretch of the whole order has the mixture of the whole table; equal cuts of it are the shards. The
fraction of a source's first row is a seeded offset of that source, so small sources are spread too.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

SEED = 20240229


def interleave(docs: DataFrame, shards: int, id_col: str = "doc_id", stratum: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """(id, stratum, size, text_crc32, shard, slot): shard sizes in rows differ by one at most.

    A null stratum is a stratum of its own; null text has size 1 and the CRC of nothing; null and
    repeated ids are ordinary rows (rows alike in id, text and source are interchangeable). An empty
    table gives an empty result.

    Rows are shuffled by an MD5 of id, size and CRC, so many rows without id, or of one id, don't meet in one
    bucket unless their texts are alike. Equal fractional ranks are ordered by that hash, never by the
    source's name. Columns of any name don't matter. No task gets a whole source: ranks are an offset of a bucket of hash values, from a small table of
    counts, plus the rank within the bucket. There are about sqrt(rows) buckets of sqrt(rows) rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(stratum).cast("string").alias("__of"),
        (F.octet_length(body) + 1).cast("long").alias("__size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("__crc"),
    )
    number = lambda text: F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    # 60 bits of a digest, the same in any language: of the row, and of its stratum.
    told = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("__id").cast("string"), F.lit("")), "__size", "__crc")
    of_stratum = F.concat(F.lit(f"{seed}:"), F.when(F.col("__of").isNull(), "none").otherwise(F.concat(F.lit("="), F.col("__of"))))
    rows = rows.withColumns({"__key": number(told), "__offset": number(of_stratum) / F.lit(float(1 << 60))})
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    bits = max(1, math.ceil(math.log2(max(2, total)) / 2))
    rows = rows.withColumn("__bucket", F.shiftright("__key", 60 - bits))
    counts = rows.groupBy("__of", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    of = Window.partitionBy("__of")
    counts = counts.select(
        F.col("__of").alias("__o"),
        F.col("__bucket").alias("__b"),
        (F.sum("__n").over(of.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"),
        F.sum("__n").over(of).alias("__all"),
    )
    inner = Window.partitionBy("__of", "__bucket").orderBy("__key", "__id", "__crc", "__size")
    ranked = rows.withColumn("__within", F.row_number().over(inner)).join(counts, F.col("__of").eqNullSafe(F.col("__o")) & (F.col("__bucket") == F.col("__b")))
    rank = F.col("__before") + F.col("__within") - 1
    ranked = ranked.select("__id", "__of", "__size", "__crc", "__key", ((rank + F.col("__offset")) / F.col("__all")).alias("__at"))
    ranked = ranked.withColumn("__cell", F.floor(F.col("__at") * (1 << bits)))
    ranked = materialize(ranked, "shard-ranks")
    cells = ranked.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.select(F.col("__cell").alias("__c"), (F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__start"))
    order = F.row_number().over(Window.partitionBy("__cell").orderBy("__at", "__key", "__id", "__crc", "__size", "__of"))
    placed = ranked.withColumn("__nth", order).join(cells, F.col("__cell") == F.col("__c")).withColumn("__global", F.col("__start") + F.col("__nth") - 1)
    placed = placed.withColumn("__shard", F.expr(f"(__global * {shards}L) div {max(1, total)}L"))
    first = F.expr(f"(__shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        F.col("__id").alias(id_col),
        F.col("__of").alias(stratum),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__global") - first).cast("long").alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all documents: eight shards under the law of rows."""
    out = interleave(read_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
