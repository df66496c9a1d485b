"""Line dedup: drop the lines that too large a share of a site's pages carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table

#: A line goes when more than this share of its host's pages carry it: far above what recurs by chance and
#: far below a template's share. A line close to it may go on one host and stay on another ...
MAX_RATIO = 0.1
#: ... and at least so many pages do, so that a host of one page keeps its text.
MIN_PAGES = 5
#: The per-host line sets are broadcast up to this size, else joined by salted hosts.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def _key(line):
    """96 bits that stand for a line without its outer spaces."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, bad): for each host the keys of its boilerplate lines.

    A page counts once for a line however often it repeats there; blank lines never count. At most
    (mean lines of a page) / max_ratio lines of a host can exceed the ratio, so an array is small.
    Both counts are aggregated before the shuffle, so a host or line with most rows is no burden.
    """
    pages = docs.select(F.col(host).alias("host"), F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _key).alias("keys"))
    totals = docs.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    counts = pages.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    joined = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return joined.filter(F.col("n") > F.lit(max_ratio) * F.col("pages")).groupBy(F.col("c.host").alias("host")).agg(F.collect_list("key").alias("bad"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Documents with boilerplate lines removed from the text, plus n_lines and n_dropped.

    Null text stays null with n_lines 0; an empty text is one blank line and stays; a null host is a
    host of its own; repeated rows count as pages each. Further columns pass unchanged; columns of
    the names n_lines and n_dropped are replaced.
    """
    kept, n, dropped = _deduped(docs, host, text, max_ratio, min_pages, broadcast_bytes)
    docs = docs.drop("n_lines", "n_dropped")
    return kept.select(*docs.columns, F.col(n).alias("n_lines"), F.col(dropped).alias("n_dropped"))


def _deduped(docs: DataFrame, host: str, text: str, max_ratio: float, min_pages: int, broadcast_bytes: int) -> tuple[DataFrame, str, str]:
    """All columns with the shorter text, and the names of two more: lines, and dropped ones."""
    host_key, bad_keys, salt, at, rest, n_lines, n_dropped = (f"{x} of line dedup" for x in ("host", "bad", "salt", "at", "rest", "lines", "dropped"))
    bad = materialize(boilerplate(docs, host, text, max_ratio, min_pages), "line-dedup")
    size = bad.agg(F.sum(32 + 16 * F.size("bad"))).first()[0] or 0
    other = bad.select(F.col("host").alias(host_key), F.col("bad").alias(bad_keys))
    same = F.col(host).eqNullSafe(F.col(host_key))
    if size <= broadcast_bytes:
        joined = docs.join(F.broadcast(other), same, "left")
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"))
        copies = other.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, same & (F.col(salt) == F.col(at)), "left")
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType())])))
    lines, absent = _lines(F.col(text)), F.col(text).isNull()
    left = F.filter(lines, lambda x: ~F.array_contains(F.coalesce(F.col(bad_keys), none), _key(x)) | (F.trim(x) == ""))
    joined = joined.withColumn(rest, F.when(F.col(bad_keys).isNull(), lines).otherwise(left))
    joined = joined.withColumns({n_lines: F.when(absent, 0).otherwise(F.size(lines)).cast("long"), n_dropped: F.when(absent, 0).otherwise(F.size(lines) - F.size(rest)).cast("long")})
    return joined.withColumn(text, F.when(absent | (F.col(n_dropped) == 0), F.col(text)).otherwise(F.array_join(rest, "\n"))), n_lines, n_dropped


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents; the site of a document is its source."""
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same documents with shorter texts, their other columns as they were.

    Null texts stay null, a null source is a source of its own, repeated rows count as pages each.
    """
    return _deduped(docs, "source", "text", MAX_RATIO, MIN_PAGES, BROADCAST_BYTES)[0].select(*docs.columns)


SQL = f"""
WITH d AS (SELECT doc_id, source, text IS NULL AS absent, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, absent, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
h AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
p AS (SELECT source, trim(line) AS k, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY source, trim(line)),
b AS (SELECT p.source, p.k FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * pages)
SELECT l.doc_id, CAST(CASE WHEN any_value(absent) THEN 0 ELSE count(*) END AS BIGINT) AS n_lines, CAST(count(b.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.k
GROUP BY l.doc_id
"""
