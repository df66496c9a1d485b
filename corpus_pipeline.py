"""The corpus pipeline: five stages from raw documents to encoded text.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.

toxicity      documents that score as toxic go
line_dedup    boilerplate lines of a source leave the texts
jaccard_join  of each group of near-duplicate documents the one of the smallest doc_id stays
decontaminate benchmark passages leave the texts
bpe           the remaining texts, encoded and decoded
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wiretide.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from wiretide.llm.common import materialize, read_table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: SQL expresses neither the trained classifier nor the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
