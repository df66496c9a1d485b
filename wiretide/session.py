"""Session factory: the settings that every query of this package assumes."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def get_spark(app: str = "wiretide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; an existing session is reused."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[*]")) if master or not os.environ.get("SPARK_MASTER") else builder
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    """One folder of this machine for a process without a shared one; a running session's setting can't be changed."""
    return "file://" + tempfile.mkdtemp(prefix="wiretide-")


def cut(df, name: str):
    """Write to the shared folder (spark.checkpoint.dir) and read back, so that plans stay short.

    Where that setting is empty in a single process, as in tests, a folder of this machine is taken; on a
    cluster executors would not see each other's files, so there the setting is needed.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext._jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
