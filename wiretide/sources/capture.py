"""Capture files (classic pcap and pcapng): structural audit, packets, data source, writer.

A record tells where the next one begins, so where a byte range's first record begins is only known when
all before it has been followed. Ranges are read by many tasks all the same: each task guesses where
records may begin in its range, follows each guess to the end of the range and keeps a map from entry to
exit, with what it saw on the way. The maps of a file are then chained in order, which leaves exactly the
true records; a range whose true entry nobody guessed is followed again from there. Sums over the
ranges number the packets. No step holds more of a file than a range.

The driver only lists names. Files of this machine or of a mounted store are opened by the workers, as are
those of a store named in RANGED; files of any other store arrive as rows of Spark's binary source.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic numbers with byte order and time units a second, and pcapng block types.
CLASSIC_MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
NG_MAGIC = b"\x0a\x0d\x0d\x0a"
NG_ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
SECTION, INTERFACE, PACKET = 0x0A0D0D0A, 1, 6
TIME_RESOLUTION = 9

#: Bytes of a file that one task reads, and bytes behind them in which every header that begins before lies.
CHUNK_BYTES, SLACK = 16 << 20, 64
LARGEST = (1 << 31) - 1
SUFFIXES = (".pcap", ".pcapng", ".cap")
#: Stores (as in s3://) whose files workers read in ranges through Arrow, where it has access to them.
RANGED: tuple[str, ...] = ()
PACKET_SCHEMA = "capture_id string, packet_number long, ts double, caplen int, wirelen int, linktype int, frame binary"
AUDIT_SCHEMA = "capture_id string, path string, sha256 string, capture_format string, endianness string, packet_count long, snaplen long, snaplen_note string, snaplen_truncated_packet_count long, snaplen_truncated_first_packet_number long, error string, message string"
#: What was seen between an entry and the exit of a range. broken: place, number of the rule and length of the first damage.
WALK = "entry long, byte_order string, exit long, exit_order string, packets long, short long, first_short long, snaplens array<long>, named long, fresh boolean, links array<int>, ticks array<double>, broken array<long>, halted boolean"


class CaptureTruncated(Exception):
    """The file ends inside a header or record."""


class CaptureCorrupt(CaptureTruncated):
    """A length in the file contradicts the file."""


class CaptureFormat(Exception):
    """The file is of no known capture format."""


ERRORS = {kind.__name__: kind for kind in (CaptureTruncated, CaptureCorrupt, CaptureFormat)}

#: Of several rules that the same record breaks, the first one names the damage.
RULES = [
    (CaptureCorrupt, "a record is longer than the snap length"),
    (CaptureTruncated, "a record runs past the end of the file"),
    (CaptureCorrupt, "a block has a length that no block can have"),
    (CaptureTruncated, "a block runs past the end of the file"),
    (CaptureCorrupt, "the two lengths of a block differ"),
    (CaptureCorrupt, "a packet block has no room for its lengths"),
    (CaptureTruncated, "an interface block has no room for a snap length"),
    (CaptureTruncated, "the last bytes are too few for a header"),
]
TOO_LONG, PAST_END, NO_LENGTH, BLOCK_PAST_END, LENGTHS_DIFFER, NO_PACKET, NO_SNAPLEN, NO_HEADER = range(8)

Read = Callable[[int, int], bytes]


@dataclass
class Head:
    """What the beginning of a file says; records begin at `start`."""

    capture_format: str
    order: str
    unit: int
    start: int
    snaplen: int
    link: int


@dataclass
class Structure:
    """What the audit finds out."""

    capture_format: str
    endianness: str
    record_count: int
    is_structurally_empty: bool
    snaplen: int | None
    snaplen_note: str | None
    snaplen_truncated_packet_numbers: tuple[int, ...]


@dataclass
class Walk:
    """The records of a range from one entry on, as far as each leads to the next; see WALK."""

    entry: int
    byte_order: str
    exit: int = 0
    exit_order: str = ""
    packets: int = 0
    short: int = 0
    first_short: int | None = None
    snaplens: list[int] = field(default_factory=list)
    named: int = 0
    fresh: bool = False
    links: list[int] = field(default_factory=list)
    ticks: list[float] = field(default_factory=list)
    broken: list[int] | None = None
    halted: bool = False

    def cut_short(self, number: int, numbers: list[int] | None) -> None:
        self.short += 1
        self.first_short = self.first_short or number
        if numbers is not None:
            numbers.append(number)

    def breaks(self, at: int, rule: int, size: int) -> None:
        self.broken = self.broken or [at, rule, size]


def open_file(path: str):
    """A file of this machine, or of a store that Arrow knows."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb", buffering=0)
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def reader(path: str, content: bytes | None = None) -> Read:
    """A function (place, count) that reads a file's bytes, or those given as its content."""
    if content is not None:
        return lambda at, count: bytes(content[at : at + count])
    file = open_file(path)

    def read(at: int, count: int) -> bytes:
        file.seek(at)
        parts, left = [], count
        while left > 0 and (got := file.read(left)):
            parts.append(got)
            left -= len(got)
        return b"".join(parts)

    return read


def read_head(read: Read, total: int) -> Head:
    """The head of a file; raises where there is no usable one."""
    data = read(0, 24)
    magic = data[:4]
    if total < 4:
        raise CaptureTruncated(f"{total} bytes are too few for a format magic")
    if magic in CLASSIC_MAGICS:
        if total < 24:
            raise CaptureTruncated(f"the file header has {total} of 24 bytes")
        order, unit = CLASSIC_MAGICS[magic]
        snaplen, link = struct.unpack_from(order + "II", data, 16)
        return Head("pcap", order, unit, 24, snaplen, link & 0x0FFFFFFF)
    if magic == NG_MAGIC:
        if total < 12:
            raise CaptureTruncated(f"the section header has {total} of 12 bytes")
        order = NG_ORDERS.get(data[8:12])
        if order is None:
            raise CaptureFormat("the section header names no known byte order")
        return Head("pcapng", order, 0, 0, 0, 0)
    raise CaptureFormat("neither classic pcap nor pcapng")


def walk(head: Head, read: Read, data: bytes, base: int, stop: int, total: int, entry: int, order: str, numbers: list[int] | None = None) -> Walk:
    """Follow the records that begin from `entry` on and before `stop`; data: the bytes from `base` to SLACK behind stop.

    numbers, if given, gets the place within the range of each packet that was cut short.
    """
    seen = Walk(entry, order)
    (_classic if head.capture_format == "pcap" else _blocks)(head, read, data, base, stop, total, seen, numbers)
    return seen


def _classic(head: Head, read: Read, data: bytes, base: int, stop: int, total: int, seen: Walk, numbers: list[int] | None) -> None:
    lengths, at, packets, snaplen = struct.Struct(head.order + "II").unpack_from, seen.entry, 0, head.snaplen
    # Where a whole header fits, this loop runs for each packet, so it is kept short.
    while at < stop and total - at >= 16:
        kept, sent = lengths(data, at - base + 8)
        packets += 1
        if kept < sent or kept > snaplen or at + 16 + kept > total:
            if kept > snaplen:
                seen.breaks(at, TOO_LONG, 16 + kept)
            elif at + 16 + kept > total:
                seen.breaks(at, PAST_END, 16 + kept)
            if kept < sent:
                seen.cut_short(packets, numbers)
        at += 16 + kept
    seen.packets = packets
    if at < stop:
        seen.breaks(at, NO_HEADER, total - at)
        at = total
    seen.exit, seen.exit_order = at, head.order


def _blocks(head: Head, read: Read, data: bytes, base: int, stop: int, total: int, seen: Walk, numbers: list[int] | None) -> None:
    order, at = seen.byte_order, seen.entry
    while at < stop:
        if total - at < 8:
            seen.breaks(at, NO_HEADER, total - at)
            seen.halted = True
            break
        here = at - base
        kind, size = struct.unpack_from(order + "II", data, here)
        if kind == SECTION:
            following = NG_ORDERS.get(data[here + 8 : here + 12], order)
            if following != head.order and (rule := _block_rule(head.order, struct.unpack_from(head.order + "I", data, here + 4)[0], at, total, SECTION, None)) is not None:
                # The audit reads the whole file in the order of its first section, as the format's plain readers do.
                seen.breaks(at, rule, struct.unpack_from(head.order + "I", data, here + 4)[0])
            order = following
            size = struct.unpack_from(order + "I", data, here + 4)[0]
            seen.fresh, seen.links, seen.ticks = True, [], []
        rule = _block_rule(order, size, at, total, kind, lambda: data[here + size - 4 : here + size] if here + size <= len(data) else read(at + size - 4, 4))
        if rule is not None:
            seen.breaks(at, rule, size)
            seen.halted = True
            break
        if kind == PACKET:
            seen.packets += 1
            kept, sent = struct.unpack_from(order + "II", data, here + 20)
            if kept < sent:
                seen.cut_short(seen.packets, numbers)
        elif kind == INTERFACE:
            link, tick, snaplen = _interface(data[here : here + size] if here + size <= len(data) else read(at, size), order)
            seen.named += 1
            if snaplen not in seen.snaplens:
                seen.snaplens.append(snaplen)
            seen.links.append(link)
            seen.ticks.append(tick)
        at += size
    seen.exit, seen.exit_order = at, order


def _block_rule(order: str, size: int, at: int, total: int, kind: int, again: Callable[[], bytes] | None) -> int | None:
    """The first rule that a block breaks."""
    if size < 12 or size % 4:
        return NO_LENGTH
    if at + size > total:
        return BLOCK_PAST_END
    if again and struct.unpack(order + "I", again())[0] != size:
        return LENGTHS_DIFFER
    if kind == PACKET and size < 32:
        return NO_PACKET
    if kind == INTERFACE and size < 20:
        return NO_SNAPLEN
    return None


def _interface(block: bytes, order: str) -> tuple[int, float, int]:
    """(link type, seconds of a time unit, snap length)."""
    link, _, snaplen = struct.unpack_from(order + "HHI", block, 8)
    options, end = 16, len(block) - 4
    while options + 4 <= end:
        code, length = struct.unpack_from(order + "HH", block, options)
        if code == TIME_RESOLUTION and length:
            raw = block[options + 4]
            return link, 2.0 ** -(raw & 0x7F) if raw & 0x80 else 10.0**-raw, snaplen
        if not code:
            break
        options += 4 + length + -length % 4
    return link, 1e-6, snaplen


#: How many likely entries of a range are followed, over how many bytes they are looked for, and how
#: many headers in a row must look sound. A wrong guess costs time only.
GUESSES, REACH, SOUND = 8, 1 << 20, 4
#: Block types that a guess may begin with.
LIKELY = np.array([1, 2, 3, 4, 5, 6, SECTION, 0x0BAD, 0x40000BAD], np.uint32)


def guesses(head: Head, data: bytes, base: int) -> list[tuple[int, str]]:
    """(place, byte order) where a record may begin in a range that doesn't start with one."""
    found = []
    window = data[: REACH + 32]
    for order in head.order if head.capture_format == "pcap" else "<>":
        places = []
        for phase in range(4):
            if head.capture_format == "pcapng" and (base + phase) % 4:
                continue
            v = np.frombuffer(window, order + "u4", max(0, (len(window) - phase) // 4), phase) if len(window) > phase + 4 else np.zeros(0, np.uint32)
            if len(v) < 4:
                continue
            if head.capture_format == "pcap":
                sound = (v[1:-2] < head.unit) & (v[2:-1] <= head.snaplen) & (v[2:-1] > 0) & (v[2:-1] <= v[3:])
            else:
                sound = np.isin(v[:-1], LIKELY) & (v[1:] % 4 == 0) & (v[1:] >= 12) & (v[1:] <= REACH)
            places += (np.flatnonzero(sound) * 4 + phase).tolist()
        passed: set[int] = set()
        count = 0
        for place in sorted(places):
            # What an earlier guess leads to is no entry, if that guess is right; if not, the chain is followed again.
            if place not in passed and _sound(head, window, place, order, passed):
                found.append((base + place, order))
                count += 1
                if count == GUESSES:
                    break
    return found


def _sound(head: Head, data: bytes, at: int, order: str, passed: set[int]) -> bool:
    """Whether some headers in a row look as headers do, as far as data goes; if so, all that follow have been passed."""
    header, classic, places = struct.Struct(order + "IIII").unpack_from, head.capture_format == "pcap", []
    while at + 16 <= len(data):
        a, b, c, d = header(data, at)
        if classic:
            fits, size = b < head.unit and c <= head.snaplen and c <= d, 16 + c
        else:
            fits, size = b >= 12 and not b % 4 and (at + b > len(data) or struct.unpack_from(order + "I", data, at + b - 4)[0] == b), b
        if not fits:
            if len(places) < SOUND:
                return False
            break
        places.append(at)
        at += size
    passed.update(places)
    return True


def follow(pieces: Iterator[dict], numbers: list[int] | None = None) -> Iterator[tuple[dict, Walk, int, list[int], list[float]]]:
    """(piece, walk, packets before, interfaces before) of the pieces of one file in their order.

    A piece has path, content, start, stop, total, its file's head, and the walks from its guesses. Where
    none begins at the true entry, the piece is followed from there now.
    """
    at, order, before, links, ticks = 0, "", 0, [], []
    for piece in pieces:
        head = piece["head"]
        if not piece["start"]:
            at, order = head.start, head.order
            if head.capture_format == "pcap":
                links, ticks = [head.link], [1 / head.unit]
        if at >= piece["stop"]:
            continue
        seen = next((w for w in piece.get("walks", ()) if w.entry == at and w.byte_order == order), None)
        if seen is None:
            read = reader(piece["path"], piece.get("content"))
            seen = walk(head, read, read(piece["start"], piece["stop"] + SLACK - piece["start"]), piece["start"], piece["stop"], piece["total"], at, order, numbers)
            if numbers is not None:
                numbers[-seen.short :] = [n + before for n in numbers[-seen.short :]] if seen.short else numbers[len(numbers) :]
        yield piece, seen, before, links, ticks
        if seen.halted:
            return
        before += seen.packets
        links, ticks = (seen.links, seen.ticks) if seen.fresh else (links + seen.links, ticks + seen.ticks)
        at, order = seen.exit, seen.exit_order


def pieces_of(path: str, content: bytes | None, total: int, chunk_bytes: int) -> Iterator[dict]:
    """The pieces of a file that one process follows alone; nothing is guessed."""
    head = read_head(reader(path, content), total)
    for start in range(0, max(total, 1), chunk_bytes):
        yield {"path": path, "content": content, "start": start, "stop": min(total, start + chunk_bytes), "total": total, "head": head}


def _error(path: str, broken: list[int], total: int) -> tuple[str, str]:
    at, rule, size = broken
    return RULES[rule][0].__name__, f"{path}: {RULES[rule][1]} (byte {at}, length {size}, file of {total} bytes)"


def summary(path: str, followed: Iterator[tuple[dict, Walk, int, list[int], list[float]]], head: Head) -> dict:
    """The columns of AUDIT_SCHEMA but the digest, from the true walks of a file."""
    packets = short = named = 0
    first, snaplens = None, set()
    for piece, seen, before, _, _ in followed:
        if seen.broken:
            error, message = _error(path, seen.broken, piece["total"])
            return {"error": error, "message": message}
        first = before + seen.first_short if first is None and seen.first_short else first
        packets, short, named = packets + seen.packets, short + seen.short, named + seen.named
        snaplens |= set(seen.snaplens)
    if head.capture_format == "pcap":
        named, snaplens = 1, {head.snaplen}
    note = None if len(snaplens) == 1 else f"{named} interface blocks name {len(snaplens)} snap lengths, so there is no single one"
    return {"capture_format": head.capture_format, "endianness": "little" if head.order == "<" else "big", "packet_count": packets, "snaplen": min(snaplens) if note is None else None, "snaplen_note": note, "snaplen_truncated_packet_count": short, "snaplen_truncated_first_packet_number": first}


def audit(path: str | Path) -> Structure:
    """The audit of one file of this machine: content is not looked at and never part of a message."""
    if not Path(path).exists():
        raise FileNotFoundError(f"The capture file does not exist: {path}")
    path, total = str(path), Path(path).stat().st_size
    numbers: list[int] = []
    try:
        head = read_head(reader(path), total)
    except (CaptureTruncated, CaptureFormat) as error:
        raise type(error)(f"{path}: {error}") from None
    found = summary(path, follow(pieces_of(path, None, total, CHUNK_BYTES), numbers), head)
    if "error" in found:
        raise ERRORS[found["error"]](found["message"])
    return Structure(found["capture_format"], found["endianness"], found["packet_count"], not found["packet_count"], found["snaplen"], found["snaplen_note"], tuple(numbers))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the capture files in a folder, in any store that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target):
        raise FileNotFoundError(f"The capture file does not exist: {path}")
    alone = store.getFileStatus(target).isFile()
    found = [(x.getPath().toString(), x.getLen()) for x in store.listStatus(target) if alone or x.isFile() and x.getPath().getName().endswith(SUFFIXES)]
    return sorted((p.removeprefix("file:"), n) for p, n in found)


def is_ranged(path: str) -> bool:
    """Whether workers read ranges of a file themselves."""
    return "://" not in path or path.split("://")[0] in RANGED


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in columns.split(", "))])


PIECE = "path string, start long, stop long, total long, capture_format string, byte_order string, unit long, first long, snaplen long, link long, error string, message string"


def _guessed(spark: SparkSession, files: list[tuple[str, int]], chunk_bytes: int) -> DataFrame:
    """A row (PIECE, walks) for each range of the given files that workers can open, in any order."""
    listed = spark.createDataFrame(files, "path string, total long")
    ranges = listed.select("path", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long"))).alias("start"))
    pieces = sum(n // chunk_bytes + 1 for _, n in files)
    ranges = ranges.repartition(max(1, min(pieces, 20_000)), "path", "start")
    kinds = pa.schema([*_schema(PIECE), ("walks", pa.list_(pa.struct(list(_schema(WALK)))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, start in zip(*(c.to_pylist() for c in batch.columns)):
                read, stop = reader(path), min(total, start + chunk_bytes)
                row = {"path": path, "start": start, "stop": stop, "total": total, "walks": []}
                try:
                    head = read_head(read, total)
                except (CaptureTruncated, CaptureFormat) as error:
                    if not start:
                        yield pa.RecordBatch.from_pylist([row | {"error": type(error).__name__, "message": f"{path}: {error}"}], schema=kinds)
                    continue
                data = read(start, stop + SLACK - start)
                entries = guesses(head, data, start) if start else [(head.start, head.order)]
                walks = [walk(head, read, data, start, stop, total, at, order) for at, order in entries if at < stop]
                row |= {"capture_format": head.capture_format, "byte_order": head.order, "unit": head.unit, "first": head.start, "snaplen": head.snaplen, "link": head.link, "walks": [vars(w) for w in walks]}
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return ranges.mapInArrow(run, f"{PIECE}, walks array<struct<{', '.join(c.replace(' ', ':', 1) for c in WALK.split(', '))}>>")


def _chained(guessed: DataFrame, solve: Callable[[str, Iterator[dict]], Iterator[dict]], columns: str) -> DataFrame:
    """solve(path, pieces in order) for each file: its pieces come one by one."""
    kinds = _schema(columns)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                row["walks"] = [Walk(**w) for w in row["walks"]]
                row["head"] = row["error"] is None and Head(row["capture_format"], row["byte_order"], row["unit"], row["first"], row["snaplen"], row["link"])
                yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        for path, rows in groupby(pieces(batches), key=lambda row: row["path"]):
            for out in solve(path, rows):
                yield pa.RecordBatch.from_pylist([out], schema=kinds)
            for _ in rows:  # what lies behind a damage
                pass

    return guessed.repartition("path").sortWithinPartitions("path", "start").mapInArrow(run, columns)


def _audited(path: str, pieces: Iterator[dict]) -> Iterator[dict]:
    first = next(pieces)
    if first["error"]:
        yield {"path": path, "error": first["error"], "message": first["message"]}
        return

    def again() -> Iterator[dict]:
        yield first
        yield from pieces

    yield {"path": path} | summary(path, follow(again()), first["head"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sha256) of files, read from beginning to end in bounded memory."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            digest, read, at = hashlib.sha256(), reader(path), 0
            while part := read(at, 4 << 20):
                digest.update(part)
                at += len(part)
            yield pa.RecordBatch.from_pylist([{"path": path, "sha256": digest.hexdigest()}])


def digests(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(path, sha256) of files of any size that workers can open."""
    listed = spark.createDataFrame([(p,) for p, _ in files], "path string").repartition(max(1, min(len(files), 20_000)), "path")
    return listed.mapInArrow(_digests, "path string, sha256 string")


def _delivered(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(path, content) of files that come through Spark's binary source, which has no rows for empty files."""
    empty = spark.createDataFrame([(p, b"") for p, n in files if not n], "path string, content binary")
    full = [p for p, n in files if n]
    return spark.read.format("binaryFile").load(full).select("path", "content").unionByName(empty) if full else empty


def audit_files(spark: SparkSession, files: list[tuple[str, int]], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each listed file, damaged ones with the name of the error instead of counts."""
    near, far = [f for f in files if is_ranged(f[0])], [f for f in files if not is_ranged(f[0])]
    columns = ", ".join(c for c in AUDIT_SCHEMA.split(", ") if c.split()[0] not in ("capture_id", "sha256"))
    kinds = _schema(AUDIT_SCHEMA)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                row = {"capture_id": _name(path), "path": path, "sha256": hashlib.sha256(content).hexdigest()}
                try:
                    head = read_head(reader(path, content), len(content))
                except (CaptureTruncated, CaptureFormat) as error:
                    row |= {"error": type(error).__name__, "message": f"{path}: {error}"}
                else:
                    row |= summary(path, follow(pieces_of(path, content, len(content), chunk_bytes)), head)
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    out = []
    if near or not far:
        audits = _chained(_guessed(spark, near, chunk_bytes), _audited, columns)
        named = audits.join(digests(spark, near), "path").withColumn("capture_id", F.element_at(F.split("path", "/"), -1))
        out.append(named.select(*kinds.names))
    if far:
        out.append(_delivered(spark, far).mapInArrow(whole, AUDIT_SCHEMA))
    return out[0].unionByName(out[1]) if len(out) > 1 else out[0]


def verify_checksums(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(name, sha256, found, state) of the files of a data set against expected (name, sha256).

    state: ok, differs, missing, or unexpected for a file that nothing is expected of.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.lower("sha256") == F.col("found"), "ok").otherwise("differs")
    return expected.select("name", "sha256").join(files, "name", "full").select("name", "sha256", "found", state.alias("state"))


CHUNK_SCHEMA = "capture_id string, path string, capture_format string, byte_order string, unit long, links array<int>, ticks array<double>, start long, stop long, before long, packets long, data binary"


def chunks(path: str, followed: Iterator[tuple[dict, Walk, int, list[int], list[float]]]) -> Iterator[dict]:
    """Ranges of a file from one packet's record to another's, as far as its records can be followed."""
    for piece, seen, before, links, ticks in followed:
        # A damaged file is read up to the damage; so is a classic record whose end is missing.
        stop = min(piece["total"], seen.exit)
        if seen.packets:
            content = piece.get("content")
            head = piece["head"]
            yield {"capture_id": _name(path), "path": path, "capture_format": head.capture_format, "byte_order": seen.byte_order, "unit": head.unit, "links": links, "ticks": ticks, "start": seen.entry, "stop": stop, "before": before, "packets": seen.packets, "data": None if content is None else bytes(content[seen.entry : stop])}


def _cut(path: str, pieces: Iterator[dict]) -> Iterator[dict]:
    def sound() -> Iterator[dict]:
        for piece in pieces:
            if piece["error"]:
                raise ERRORS[piece["error"]](piece["message"])
            yield piece

    yield from chunks(path, follow(sound()))


def _packets(chunk: dict, low: int = 0, high: float = float("inf"), frames: bool = True) -> Iterator[tuple]:
    """Packets of a chunk with numbers from low to high; without their frames, if those are not wanted."""
    data, order, links, ticks = chunk["data"], chunk["byte_order"], list(chunk["links"]), list(chunk["ticks"])
    if data is None:
        data = reader(chunk["path"])(chunk["start"], chunk["stop"] - chunk["start"])
    at, number = 0, chunk["before"]
    while at < len(data):
        if chunk["capture_format"] == "pcap":
            if len(data) - at < 16:
                return
            seconds, fraction, kept, sent = struct.unpack_from(order + "IIII", data, at)
            body, following = at + 16, at + 16 + kept
            when, link = seconds + fraction / chunk["unit"], links[0]
        else:
            kind, size = struct.unpack_from(order + "II", data, at)
            if kind == SECTION:
                order = NG_ORDERS.get(data[at + 8 : at + 12], order)
                size, links, ticks = struct.unpack_from(order + "I", data, at + 4)[0], [], []
            elif kind == INTERFACE:
                link, tick, _ = _interface(data[at : at + size], order)
                links.append(link)
                ticks.append(tick)
            if kind != PACKET:
                at += size
                continue
            interface, above, below, kept, sent = struct.unpack_from(order + "IIIII", data, at + 8)
            known = interface < len(links)
            link, tick = (links[interface], ticks[interface]) if known else (1, 1e-6)
            body, following = at + 28, at + size
            when = (above << 32 | below) / round(1 / tick)
        number += 1
        if number > high:
            return
        if number >= low:
            # Lengths that no damage-free file has don't fit the columns; the largest int stands for them.
            yield chunk["capture_id"], number, when, min(kept, LARGEST), min(sent, LARGEST), link, data[body : body + kept] if frames else None
        at = following


def _batches(rows: Iterator[tuple], columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of packets, with the given columns of PACKET_SCHEMA."""
    schema = _schema(PACKET_SCHEMA)
    wanted = [schema.names.index(c) for c in columns or schema.names]
    held: list[tuple] = []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], schema.types[k]) for k in wanted], names=[schema.names[k] for k in wanted])
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pack()
            held.clear()
    if held:
        yield pack()


def find_chunks(spark: SparkSession, files: list[tuple[str, int]], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ranges (CHUNK_SCHEMA) of listed files that begin with a packet, each with the number of packets before it."""
    near, far = [f for f in files if is_ranged(f[0])], [f for f in files if not is_ranged(f[0])]
    kinds = _schema(CHUNK_SCHEMA)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                for chunk in chunks(path, follow(pieces_of(path, content, len(content), chunk_bytes))):
                    yield pa.RecordBatch.from_pylist([chunk], schema=kinds)

    out = [_chained(_guessed(spark, near, chunk_bytes), _cut, CHUNK_SCHEMA)] if near or not far else []
    if far:
        out.append(_delivered(spark, far).mapInArrow(whole, CHUNK_SCHEMA))
    return out[0].unionByName(out[1]) if len(out) > 1 else out[0]


def read_captures(spark: SparkSession, paths: list[str | Path], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Packets of files and folders. Files are not audited: damaged ones are read as far as their records go.

    A file without a usable head raises.
    """
    files = [x for p in paths for x in list_files(spark, str(p))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(packet for batch in batches for chunk in batch.to_pylist() for packet in _packets(chunk))

    pieces = sum(n // chunk_bytes + 1 for _, n in files)
    return find_chunks(spark, files, chunk_bytes).repartition(max(1, min(pieces, 20_000)), "path", "start").mapInArrow(read, PACKET_SCHEMA)


def read_capture(spark: SparkSession, path: str | Path, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Packets of a capture file or a folder of them."""
    return read_captures(spark, [path], chunk_bytes)


def slice_packets(packets: DataFrame, skip: int, take: int) -> DataFrame:
    """Packets skip+1 to skip+take of each capture."""
    return packets.filter(F.col("packet_number").between(skip + 1, skip + take))
