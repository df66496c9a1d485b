"""Exact dedup by most-significant-digit radix partitioning over the bytes of the texts.

Level by level the documents are split by their next bytes. A group of one is done, and so is a group
whose texts have ended; only the others go to the next, wider, digit. Groups are told apart by their
bytes alone, so equality needs no digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Bytes of the first digit; every further digit is GROW times as wide.
FIRST, GROW = 48, 4
#: The first level's groups are broadcast to the documents up to this size, which spares a shuffle of
#: all texts. The rows of later levels are few and always shuffled, so that each size behaves alike.
BROADCAST_BYTES = 16 << 20


def normalise(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _level(active: DataFrame, width: int, broadcast_bytes: int) -> DataFrame:
    """One radix level: __n and __keep of the group of every row, __over if the group is settled.

    __group names the bytes that the rows have in common so far: the first digit itself, later the
    number of one row of the group. Only the bytes after the digit go on.
    """
    rest = F.expr(f"substring(__bytes, {width + 1}, 2147483647)")
    rows = active.withColumns({"__digit": F.substring("__bytes", 1, width), "__rest": rest, "__ended": F.octet_length("__bytes") <= width}).drop("__bytes")
    numbered = "__row" in active.columns
    name = F.min("__row").cast("string").cast("binary") if numbered else F.first("__digit")
    groups = rows.groupBy("__group", "__digit", "__ended").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__keep"), name.alias("__next"))
    groups = materialize(groups.filter("__n > 1"), "radix-groups")
    size = groups.agg(F.sum(F.octet_length("__digit") + 64)).first()[0] or 0
    other = groups.select(F.col("__group").alias("__g"), F.col("__digit").alias("__d"), F.col("__ended").alias("__e"), "__n", "__keep", "__next")
    same = (F.col("__group") == F.col("__g")) & (F.col("__digit") == F.col("__d")) & (F.col("__ended") == F.col("__e"))
    joined = rows.join(F.broadcast(other) if not numbered and size <= broadcast_bytes else other.hint("merge"), same, "left")
    over = F.col("__n").isNull() | F.col("__ended")
    row = F.col("__row") if numbered else F.monotonically_increasing_id()
    level = joined.select("__id", "__sha", row.alias("__row"), over.alias("__over"), "__n", "__keep", F.when(~over, F.col("__next")).alias("__group"), F.when(~over, F.col("__rest")).alias("__bytes"))
    return materialize(level, "radix-level")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", first: int = FIRST, grow: int = GROW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are compared after white space is folded. Null text is empty, and empty texts are equal. A
    null id is never the smallest unless all ids of its group are null; then keep_id is null and all
    these rows are kept. Rows that repeat the smallest id of a group are ties and all of them are
    kept. Other columns don't matter. An empty table gives an empty result.

    Every level counts with partial aggregation, so a group of copies costs a row for each task, and
    the join back to the documents can split such a group (adaptive skew join) or needs no shuffle.
    The number of levels grows with the logarithm of the longest text that shares its start.
    """
    text_col = normalise(F.col(text))
    rows = docs.select(F.col(id_col).alias("__id"), text_col.alias("__text"))
    active = rows.select("__id", F.sha2("__text", 256).alias("__sha"), F.expr("X''").alias("__group"), F.encode("__text", "UTF-8").alias("__bytes"))
    parts, width = [], first
    while True:
        level = _level(active, width, broadcast_bytes)
        parts.append(level.filter("__over").select("__id", "__sha", "__n", "__keep"))
        active = level.filter("NOT __over").select("__id", "__sha", "__row", "__group", "__bytes")
        if active.isEmpty():
            break
        width *= grow
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    alone = F.col("__n").isNull()
    keep = F.when(alone, F.col("__id")).otherwise(F.col("__keep"))
    return out.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("__id")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over all documents."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
