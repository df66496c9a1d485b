"""Text files of any number and size, read by the workers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _plain(path):
    return F.regexp_replace(path, "^file:/*(?=/)", "")


def read_text_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(path, content) of all files below path, each 2 GB at most; content is null where a file is no UTF-8 text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(_plain("path").alias("path"), text.alias("content"))


def numbered_pieces(spark: SparkSession, path: str | list[str], glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Lines (path, block, at, text) and blocks (path, block, before, readable) of files of any size.

    Spark's text source cuts a file into blocks, for many tasks, and gives what lies between line feeds; other line
    ends cut that further. A line's number is the block's `before` plus its own `at`; lines of a block come in
    their order. readable is false in all blocks of a file that is no UTF-8 text.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    raw = raw.select(_plain(name).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    # Bytes as characters; a carriage return before the line feed belongs to it.
    row = F.regexp_replace(F.decode("value", "ISO-8859-1"), "\r\\z", "")
    inner = "[\r\u000b\u000c\u001c\u001d\u001e]|Â\u0085|â\u0080[¨©]"
    sound = F.is_valid_utf8(F.col("value").cast("string"))
    counts = raw.groupBy("path", "block").agg(F.sum(F.size(F.split(row, inner, -1))).alias("n"), F.min(sound).alias("sound"))
    of = Window.partitionBy("path")
    before = F.sum("n").over(of.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = counts.select("path", "block", before.alias("before"), F.min("sound").over(of).alias("readable"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = re.compile("[\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")
        now, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for path, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, block) != now:
                    now, at = (path, block), 0
                for text in ends.split(value.removesuffix(b"\r").decode("utf-8", "replace")):
                    at += 1
                    out.append((path, block, at, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "block", "at", "text"])

    return raw.mapInArrow(number, "path string, block long, at long, text string"), blocks


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(path, line from 1, text, readable) of all files below path, of any size; empty files have no lines.

    Behind a last line that ends without a line feed but with another line end, an empty line more is given.
    """
    pieces, blocks = numbered_pieces(spark, path, glob)
    named = blocks.withColumnsRenamed({"path": "p", "block": "b"})
    joined = pieces.join(named, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    return joined.select("path", (F.col("before") + F.col("at")).alias("line"), "text", "readable")
