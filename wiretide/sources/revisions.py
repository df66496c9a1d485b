"""A git repository as tables: its objects, what each revision holds, and its messages.

Index files give every object's place in its pack, so that many tasks read one pack. An object that is stored as a
difference is put together once its base is there: a round of joins for each link of the longest chain. Workers open
pack files themselves, so these must lie on a file system that all of them see.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Kinds of packed objects; those that are differences name their base by place or by id.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "by place", 7: "by id"}
#: Head of an index file of version 2, and the entries of a tree that are folders or other repositories.
INDEX_HEAD, FOLDER, LINK = b"\xfftOc\x00\x00\x00\x02", "40000", "160000"
#: Objects that one task reads from a pack.
OBJECTS = 20_000
STORED = "pack string, oid string, start long, kind string, base_start long, base string, data binary"


class RevisionError(Exception):
    """The store lacks an object that another one needs, or a file of it is of an unknown form."""


def _batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def index_rows(path: str, content: bytes) -> list[tuple[str, str, int]]:
    """(pack, oid, start) of the objects of one index file."""
    if content[:8] != INDEX_HEAD:
        raise RevisionError(f"{path}: not an index of version 2")
    n = struct.unpack_from(">I", content, 8 + 255 * 4)[0]
    names = 8 + 256 * 4
    near = names + 24 * n
    starts = np.frombuffer(content, ">u4", n, near).astype(np.int64)
    far = np.frombuffer(content, ">u8", (len(content) - 40 - near - 4 * n) // 8, near + 4 * n)
    wide = starts >> 31 == 1
    starts[wide] = far[starts[wide] & 0x7FFFFFFF].astype(np.int64)
    pack = path.removesuffix(".idx") + ".pack"
    return [(pack, content[names + 20 * k : names + 20 * k + 20].hex(), s) for k, s in enumerate(starts.tolist())]


def packed(handle, start: int) -> tuple[str, int | None, str | None, bytes]:
    """(kind, place of the base, id of the base, data) of the object at one place of an open pack."""
    handle.seek(start)
    head = handle.read(64)
    kind, at = KINDS[head[0] >> 4 & 7], 1
    while head[at - 1] & 128:
        at += 1
    base_start = base = None
    if kind == "by place":
        back, more = head[at] & 127, head[at] & 128
        at += 1
        while more:
            back, more = (back + 1) << 7 | head[at] & 127, head[at] & 128
            at += 1
        base_start = start - back
    elif kind == "by id":
        base, at = head[at : at + 20].hex(), at + 20
    handle.seek(start + at)
    inflate, parts = zlib.decompressobj(), []
    while not inflate.eof:
        piece = handle.read(1 << 16)
        if not piece:
            raise RevisionError(f"{handle.name}: ends inside the object at {start}")
        parts.append(inflate.decompress(piece))
    return kind, base_start, base, b"".join(parts)


def applied(base: bytes, delta: bytes) -> bytes:
    """What a difference makes of its base: pieces of the base and pieces of its own, in order."""
    at, sizes = 0, []
    for _ in range(2):
        size = shift = 0
        while True:
            size |= (delta[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if delta[at - 1] < 128:
                break
        sizes.append(size)
    out = []
    while at < len(delta):
        order, at = delta[at], at + 1
        if order < 128:
            out.append(delta[at : at + order])
            at += order
            continue
        place = [0] * 7
        for k in range(7):
            if order >> k & 1:
                place[k], at = delta[at], at + 1
        start = int.from_bytes(bytes(place[:4]), "little")
        out.append(base[start : start + (int.from_bytes(bytes(place[4:]), "little") or 1 << 16)])
    made = b"".join(out)
    if sizes != [len(base), len(made)]:
        raise RevisionError("a difference doesn't fit its base")
    return made


def _stored(spark: SparkSession, store: str) -> DataFrame:
    """STORED rows of all packs of a store, differences as they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(f"{store}/objects/pack")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches(index_rows(path, content), ["pack", "oid", "start"], [pa.string(), pa.string(), pa.int64()])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in STORED.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for pack, oid, start in zip(*(c.to_pylist() for c in batch.columns)):
                with open(pack, "rb") as handle:
                    kind, base_start, base, data = packed(handle, start)
                rows.append((pack, oid, start, kind, base_start, base, data))
                held += len(data)
                if held > 8 << 20:
                    yield from _batches(rows, names, kinds)
                    rows, held = [], 0
            yield from _batches(rows, names, kinds)

    named = files.select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*(?=/)", "").alias("path"), "content")
    index = cut(named.mapInArrow(places, "pack string, oid string, start long"), "object-places")
    tasks = max(spark.sparkContext.defaultParallelism, index.count() // OBJECTS)
    return index.repartitionByRange(tasks, "pack", "start").mapInArrow(read, STORED)


def _loose(spark: SparkSession, store: str) -> DataFrame:
    """(oid, kind, data) of the objects that have files of their own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{store}/objects")
    oid = F.regexp_extract("path", "/objects/([0-9a-f]{2}/[0-9a-f]{38})$", 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                head, _, data = zlib.decompress(content).partition(b"\0")
                rows.append((name, head.split(b" ")[0].decode(), data))
            yield from _batches(rows, ["oid", "kind", "data"], [pa.string(), pa.string(), pa.binary()])

    found = files.select(F.replace(oid, F.lit("/"), F.lit("")).alias("oid"), "content").filter("oid <> ''")
    return found.mapInArrow(read, "oid string, kind string, data binary")


def objects(spark: SparkSession, store: str) -> DataFrame:
    """(oid, kind, data) of every object of a store (a folder `.git`), packed or not, each once.

    A base that the store lacks raises RevisionError. Objects that no name leads to any more are there too.
    """
    return assembled(_stored(spark, store), _loose(spark, store), store)


def assembled(stored: DataFrame, loose: DataFrame, store: str) -> DataFrame:
    """(oid, kind, data) of whole objects, from STORED rows and those with files of their own."""
    stored = cut(stored, "stored-objects")
    whole = stored.filter("kind NOT LIKE 'by %'").select("oid", "kind", "data").unionByName(loose)
    known = stored.select(F.col("pack").alias("p"), F.col("start").alias("s"), F.col("oid").alias("at"))
    deltas = stored.filter("kind LIKE 'by %'").join(known, (F.col("pack") == F.col("p")) & (F.col("base_start") == F.col("s")), "left")
    deltas = cut(deltas.select("oid", F.coalesce("base", "at").alias("base"), F.col("data").alias("delta")), "differences")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            oid, kind, base, delta = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(oid, pa.string()), pa.array(kind, pa.string()), pa.array([applied(b, d) for b, d in zip(base, delta)], pa.binary())], ["oid", "kind", "data"])

    level = cut(whole.dropDuplicates(["oid"]), "objects")
    levels, left = [level], deltas.join(level.select("oid"), "oid", "left_anti").select("oid").distinct().count()
    while left:
        joined = deltas.join(level.withColumnRenamed("oid", "b"), F.col("base") == F.col("b")).select("oid", "kind", "data", "delta")
        for earlier in levels:  # several packs may hold the same object by different chains
            joined = joined.join(earlier.select("oid"), "oid", "left_anti")
        level = cut(joined.mapInArrow(build, "oid string, kind string, data binary").dropDuplicates(["oid"]), "objects")
        made = level.count()
        if not made:
            raise RevisionError(f"{left} objects have no base in {store}")
        levels.append(level)
        left -= made
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def commits(found: DataFrame) -> DataFrame:
    """(revision, pos, tree, text): pos orders revisions by time of commit, then by id."""
    text = F.decode("data", "ISO-8859-1")
    field = lambda pattern: F.regexp_extract(text, pattern, 1)
    at = field(r"(?m)^committer .* (\d+) [+-]\d{4}$").cast("long")
    # The blank line that ends the head stands at the same byte and character, as each byte is one character here.
    message = F.expr("substring(data, CAST(locate('\n\n', decode(data, 'ISO-8859-1')) + 2 AS INT))")
    rows = found.filter("kind = 'commit'").withColumn("message", message)
    return rows.select(F.col("oid").alias("revision"), F.struct(at.alias("time"), F.col("oid").alias("oid")).alias("pos"), field(r"\Atree ([0-9a-f]{40})").alias("tree"), F.coalesce(F.try_validate_utf8(F.col("message").cast("string")), F.decode("message", "ISO-8859-1")).alias("text"))


def entries(found: DataFrame) -> DataFrame:
    """(tree, mode, name, child): one row for each entry of each tree."""
    entry = re.compile(rb"(\d+) ([^\0]+)\0(.{20})", re.DOTALL)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(oid, mode.decode(), name.decode("utf-8", "replace"), child.hex()) for oid, data in zip(*(c.to_pylist() for c in batch.columns)) for mode, name, child in entry.findall(data)]
            yield from _batches(rows, ["tree", "mode", "name", "child"], [pa.string()] * 4)

    return found.filter("kind = 'tree'").select("oid", "data").mapInArrow(read, "tree string, mode string, name string, child string")


def files(found: DataFrame) -> DataFrame:
    """(revision, pos, path, oid) of every file of every revision; one round of joins for each depth of folders.

    Folders that several revisions share are walked once for each of them; other repositories are left out.
    """
    inside = cut(entries(found), "tree-entries")
    level = commits(found).select("revision", "pos", F.lit("").alias("folder"), F.col("tree").alias("at"))
    out = None
    while True:
        here = level.join(inside, F.col("at") == F.col("tree")).select("revision", "pos", F.concat("folder", "name").alias("path"), "mode", F.col("child").alias("oid"))
        here = cut(here.filter(F.col("mode") != LINK), "tree-level")
        rows = here.filter(F.col("mode") != FOLDER).drop("mode")
        out = rows if out is None else out.unionByName(rows)
        deeper = here.filter(F.col("mode") == FOLDER)
        if deeper.isEmpty():
            return out
        level = deeper.select("revision", "pos", F.concat("path", F.lit("/")).alias("folder"), F.col("oid").alias("at"))


def read_history(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(trees, messages) of a repository as `operators.records.history` takes them.

    trees: (revision, pos, path, line from 1, text), the lines of all files that are UTF-8 text in all revisions; a
    file without text, empty or not, has one row whose line and text are null, so that its name is there. messages:
    (revision, text). Revisions are all commits of the store, also those that no branch leads to any more.
    """
    found = objects(spark, store)
    text = F.try_validate_utf8(F.col("data").cast("string"))
    rows = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n\\z", ""), "\n", -1)
    lines = found.filter("kind = 'blob'").select(F.col("oid").alias("blob"), F.posexplode_outer(F.when(F.length("data") > 0, rows)).alias("at", "text"))
    listed = files(found)
    trees = listed.join(lines, F.col("oid") == F.col("blob"), "left").select("revision", "pos", "path", (F.col("at") + 1).alias("line"), "text")
    return trees, commits(found).select("revision", "text")
