"""Text helpers: folding, tokens, shingles, path patterns."""

from __future__ import annotations

import fnmatch
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line ends, as Python's splitlines knows them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
SHINGLE_WORDS = 12
#: Rows and bytes of an Arrow batch, those of the text operators: a worker holds a batch several times over.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def fold(text: str) -> str:
    """Compatibility decomposition without combining marks, case folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def _fold_batch(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def with_folded(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the folded text. ASCII rows are folded by a native expression; only others go to Python.

    Spark's collations can't stand in for this: they equate letters that decomposition keeps apart.
    """
    conf = df.sparkSession.conf
    for limit, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        conf.set(f"spark.sql.execution.arrow.{limit}", str(most))
    plain = F.coalesce(F.col(column).rlike(r"\A\p{ASCII}*\z"), F.lit(True))
    ascii_rows = df.filter(plain).withColumn(name, F.lower(column))
    return ascii_rows.unionByName(df.filter(~plain).withColumn(name, F.pandas_udf(_fold_batch, "string")(column)))


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, line from 1, text): the lines of each file, without an empty one at the end."""
    parts = F.split(content, LINE_END, -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("path", F.posexplode(kept).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def folded_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for folded paths."""
    inner = fnmatch.translate(pattern.casefold())
    return inner.replace("\\Z", "\\z").replace("(?>", "(?:")


def matches_any(path: Column, patterns: list[str]) -> Column:
    """True where the folded path matches one of the shell patterns."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | folded_path(path).rlike(glob_to_regex(pattern))
    return out
