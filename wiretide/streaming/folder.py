"""A folder that capture files are dropped into, as a stream of packets.

An extension: the batch analysis is per capture, so each micro-batch of whole files is a batch of its
own and no state is kept between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysis import Tables, tables
from ..sources.capture import read_capture


def analyse_folder(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[str, Tables], None], once: bool = True) -> StreamingQuery:
    """Call handle(path, tables) for each new file; with once, for what is there now, and end."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{pcap,pcapng}").load(folder).select("path")

    def batch(files: DataFrame, _: int) -> None:
        for path in sorted(r.path for r in files.collect()):  # names only; contents are read by the workers
            local = path.removeprefix("file:")
            handle(local, tables(read_capture(spark, local)))

    writer = found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
