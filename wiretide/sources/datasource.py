"""spark.read.format("capture") and df.write.format("capture"): capture files as a data source of Spark.

Reading takes several tasks a file where an index names its ranges (index_captures, one Spark job), else
one. Filters on packet_number, ts and capture_id leave out the ranges that an index tells apart, and
stop a file without one early; columns that the given schema leaves out are not built.

Writing is done by the tasks: each writes a part that nobody sees, and the commit names all of them into
place at once. A job that fails leaves nothing that can be seen, and what was there before stays.
"""

from __future__ import annotations

import os
import shutil
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import capture as C

INDEX_SCHEMA = C.CHUNK_SCHEMA.removesuffix(", data binary") + ", first_ts double, last_ts double"


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def index_captures(spark: SparkSession, paths: list[str | Path], folder: str, chunk_bytes: int = C.CHUNK_BYTES) -> None:
    """Write the ranges of capture files to a folder: where each begins, its packets' numbers and times.

    The files are those that workers can open; a damaged one has the ranges before the damage.
    """
    files = [x for p in paths for x in C.list_files(spark, str(p))]
    if far := [p for p, _ in files if not C.is_ranged(p)]:
        raise ValueError(f"workers can't read ranges of {far[0]}")
    kinds = C._schema(INDEX_SCHEMA)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                low, high = float("inf"), float("-inf")
                for packet in C._packets(chunk, frames=False):
                    low, high = min(low, packet[2]), max(high, packet[2])
                del chunk["data"]
                yield pa.RecordBatch.from_pylist([chunk | {"first_ts": low, "last_ts": high}], schema=kinds)

    pieces = sum(n // chunk_bytes + 1 for _, n in files)
    found = C.find_chunks(spark, files, chunk_bytes).repartition(max(1, min(pieces, 20_000)), "path", "start")
    found.mapInArrow(timed, INDEX_SCHEMA).write.parquet(folder)


@dataclass
class Bounds:
    """What filters leave: numbers, times (both ends included) and names."""

    numbers: list[float] = field(default_factory=lambda: [float("-inf"), float("inf")])
    times: list[float] = field(default_factory=lambda: [float("-inf"), float("inf")])
    names: set[str] | None = None

    def narrow(self, given: Filter) -> None:
        column, value = getattr(given, "attribute", ()), getattr(given, "value", None)
        if column == ("capture_id",) and isinstance(given, (EqualTo, In)):
            names = {value} if isinstance(given, EqualTo) else set(value)
            self.names = names if self.names is None else self.names & names
        bounds = {("packet_number",): self.numbers, ("ts",): self.times}.get(column)
        if bounds is None or value is None:
            return
        if isinstance(given, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            bounds[0] = max(bounds[0], value)
        if isinstance(given, (EqualTo, LessThan, LessThanOrEqual)):
            bounds[1] = min(bounds[1], value)
        if isinstance(given, In) and value:
            bounds[:] = [max(bounds[0], min(value)), min(bounds[1], max(value))]


@dataclass
class Part(InputPartition):
    """A range of a file, or a whole file where nothing is known of its ranges."""

    path: str
    chunk: dict | None = None


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.index = options.get("path"), options.get("index")
        self.chunk_bytes = int(options.get("chunkbytes", C.CHUNK_BYTES))
        self.columns, self.bounds = columns, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for given in filters:
            self.bounds.narrow(given)
            yield given  # Spark applies all of them to what is left.

    def partitions(self) -> list[InputPartition]:
        b = self.bounds
        wanted = lambda path: b.names is None or C._name(path) in b.names
        if self.index is None:
            path = Path(self.path.removeprefix("file://") if self.path.startswith("file://") else self.path)
            files = sorted(p for p in path.iterdir() if p.name.endswith(C.SUFFIXES)) if path.is_dir() else [path]
            return [Part(str(p)) for p in files if wanted(str(p))] or [InputPartition(None)]
        out: list[InputPartition] = []
        for r in pq.read_table(self.index.removeprefix("file://")).to_pylist():
            first, last = r["before"] + 1, r["before"] + r["packets"]
            if wanted(r["path"]) and first <= b.numbers[1] and last >= b.numbers[0] and r["first_ts"] <= b.times[1] and r["last_ts"] >= b.times[0]:
                out.append(Part(r["path"], r | {"data": None}))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Part):
            yield from C._batches(self._rows(partition), self.columns)

    def _rows(self, part: Part) -> Iterator[tuple]:
        low, high = self.bounds.numbers
        frames = "frame" in self.columns
        found = [part.chunk] if part.chunk else C.chunks(part.path, C.follow(C.pieces_of(part.path, None, os.path.getsize(part.path), self.chunk_bytes)))
        for chunk in found:
            if chunk["before"] >= high:
                return
            if chunk["before"] + chunk["packets"] >= low:
                yield from C._packets(chunk, low, high, frames)


@dataclass
class Written(WriterCommitMessage):
    """A part: its file, its packets, and what its first one is."""

    file: str
    packets: int
    first: tuple
    link: int


class CaptureWriter(DataSourceArrowWriter):
    """Tasks write parts into a hidden folder beside the target; the commit renames, or puts them together."""

    def __init__(self, options: dict, overwrite: bool):
        self.target = options["path"].removeprefix("file://").rstrip("/")
        self.single = options.get("single", "false").lower() == "true"
        self.snaplen, self.overwrite = int(options.get("snaplen", 65535)), overwrite
        self.hidden = f"{os.path.dirname(self.target) or '.'}/.{os.path.basename(self.target)}-{uuid.uuid4().hex}"

    def head(self, link: int) -> bytes:
        return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, self.snaplen, link)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        os.makedirs(self.hidden, exist_ok=True)
        # Attempts of one task don't share a file, so a second one can't harm the first.
        name = f"{self.hidden}/part-{task.partitionId():05d}-{task.taskAttemptId()}.pcap"
        count, first, link = 0, (), 1
        with open(name, "wb") as file:
            for batch in iterator:
                for r in batch.select(["capture_id", "packet_number", "ts", "wirelen", "linktype", "frame"]).to_pylist():
                    if not count:
                        first, link = (r["capture_id"], r["packet_number"]), r["linktype"]
                        file.write(b"" if self.single else self.head(link))
                    if r["linktype"] != link:
                        raise ValueError(f"a classic capture has one link type, but packet {r['packet_number']} has {r['linktype']} after {link}")
                    micros, frame = round(r["ts"] * 10**6), r["frame"]
                    file.write(struct.pack("<IIII", micros // 10**6, micros % 10**6, len(frame), r["wirelen"]) + frame)
                    count += 1
        return Written(name, count, first, link)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m and m.packets), key=lambda m: m.first)
        if os.path.exists(self.target) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.target)
        ready = f"{self.hidden}-ready"
        if self.single:
            if len({m.link for m in parts}) > 1:
                self.abort(messages)
                raise ValueError("a classic capture has one link type")
            with open(ready, "wb") as out:
                out.write(self.head(parts[0].link if parts else 1))
                for m in parts:
                    with open(m.file, "rb") as part:
                        shutil.copyfileobj(part, out, 4 << 20)
        else:
            os.makedirs(ready)
            for k, m in enumerate(parts):
                os.rename(m.file, f"{ready}/part-{k:05d}.pcap")
        if os.path.isdir(self.target):
            os.rename(self.target, f"{self.hidden}/replaced")
        os.replace(ready, self.target)
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        # A task that is being stopped may just begin, and make the folder again.
        for _ in range(4):
            shutil.rmtree(self.hidden, ignore_errors=True)
            time.sleep(0.25)


class CaptureSource(DataSource):
    """A file or folder that all workers can open.

    Reading: path, or index (a folder that index_captures wrote). Writing, from the columns of a read: path becomes a
    folder of captures, one a task, or with single=true one file with the parts in the order of their first packets.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return C.PACKET_SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(dict(self.options), overwrite)


def write_pcap(packets: DataFrame, path: str | Path, snaplen: int = 65535) -> int:
    """Write the packets of one capture as a classic pcap file, in the order of their numbers; returns how many."""
    register(packets.sparkSession)
    seen = Observation()
    ordered = packets.select("capture_id", "packet_number", "ts", "wirelen", "linktype", "frame").repartitionByRange("packet_number")
    # Observed behind the exchange: the rows before it are also read to find its ranges.
    ordered = ordered.sortWithinPartitions("packet_number").observe(seen, F.count(F.lit(1)).alias("n"))
    ordered.write.format("capture").option("single", "true").option("snaplen", str(snaplen)).mode("overwrite").save(str(path))
    return seen.get["n"]
