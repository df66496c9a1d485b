"""Groups of texts that ask segments about their words and n-grams, and meet the answers again.

A group of texts (some MB) sends each of its distinct hashes once to the segment that its leading bits
name; the segment has all that was asked of it together, and answers every group. The answers meet the
tokens of the group by its number. So nothing is gathered or broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_batches, intern_words, mix64, texts, word_hashes

#: Text that a group and a segment stand for at least, the input from which both grow with its square root,
#: and bits by which the hashes of a segment are told apart.
SEGMENT_BYTES, GROWS_FROM, LOW_BITS = 4 << 20, 32 << 30, 31
#: 256 segments at least.
LEAST_BITS = 8
#: Stands for the end of a text, and before its first word for the start; no word has a space.
END = b" "
#: The tokens of a group as they travel; ids and further columns of its rows follow.
OWN = "number long, mark long, n long, m long, a binary, b binary"
#: Parts of a plan that give the same rows in the same order each time they run.
REPEATABLE = re.compile(r"(\*\(\d+\) )?(Project|Filter|ColumnarToRow|FileScan|Scan|LocalTableScan|InputAdapter|WholeStageCodegen)\b")


class Tokens:
    """The tokens of a group of texts in order, and their n-grams."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray):
        self.ids, self.starts, self.hashes = ids.astype(np.int64), starts, hashes
        lengths = np.diff(starts)
        self.nth = np.arange(len(ids)) - np.repeat(starts[:-1], lengths)
        self.of = np.repeat(np.arange(len(lengths)), lengths)

    @classmethod
    def read(cls, values: list[bytes], ends: bool) -> Tokens:
        """Words between ASCII white space after lower-casing A-Z; with ends every text lies between two ENDs."""
        ids, starts, words = intern_words([[END, *v.lower().split(), END] if ends else v.lower().split() for v in values])
        return cls(ids, starts, word_hashes(words))

    @cached_property
    def mark(self) -> int:
        """Tells whether a group is the same when it is read again."""
        return zlib.crc32(self.hashes.tobytes(), zlib.crc32(self.ids.tobytes(), zlib.crc32(self.starts.tobytes())))

    def packed(self, number: int) -> tuple:
        """A row of OWN."""
        often = np.argsort(-np.bincount(self.ids, minlength=len(self.hashes)), kind="stable")  # small numbers for frequent words
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often))
        return number, self.mark, len(self.ids), len(self.starts) - 1, pack(np.concatenate([np.diff(self.starts).astype(np.uint32), rank[self.ids]])), self.hashes[often].tobytes()

    @classmethod
    def unpacked(cls, row: dict) -> Tokens:
        x = unpack(row["a"], row["m"] + row["n"], np.uint32)
        return cls(x[row["m"] :], np.concatenate([[0], np.cumsum(x[: row["m"]], dtype=np.int64)]), np.frombuffer(row["b"], np.uint64))

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the n-grams of 2 to order words, one row each; which of them lie in one text)."""
        last = self.hashes[self.ids]
        out, inside = np.zeros((order - 1, len(last)), np.uint64), np.zeros((order - 1, len(last)), np.bool_)
        for n in range(2, order + 1):
            with np.errstate(over="ignore"):
                before = last if n == 2 else out[n - 3]
                out[n - 2, 1:] = mix64(before[:-1] * np.uint64(0x9E3779B97F4A7C15) + last[1:] + np.uint64(n))
            inside[n - 2] = self.nth >= n - 1
        return out, inside


def pack(x: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers before their second ones."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else x
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    each = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * each, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(each, n).T).reshape(-1).view(kind)


def low_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(64 - bits - LOW_BITS)) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32)


def layout(total: int) -> tuple[int, int]:
    """(bytes of a group, leading hash bits that name a segment) for so many bytes of text.

    Each group asks each segment, so both grow with the square root of a large input: what they send
    then grows with the input, not with its square, and no segment is bounded by a cap. A group of 1 TB has 22 MB.
    """
    each = round(SEGMENT_BYTES * max(1.0, total / GROWS_FROM) ** 0.5)
    return each, max(LEAST_BITS, (total // each).bit_length())


def text_bytes(docs: DataFrame, text: str) -> int:
    """The bytes of a column, counted: a layout follows from the texts alone, not from an estimate."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=names)


def read_groups(batches: Iterator[pa.RecordBatch], ends: bool, each: int = SEGMENT_BYTES) -> Iterator[tuple]:
    """(number, table, tokens) of each group of texts (column text)."""
    number = TaskContext.get().partitionId() << 33
    for table in grouped_batches(batches, "text", each):
        yield number, table, Tokens.read(texts(table.column("text").combine_chunks()), ends)
        number += 1


def met(own: pa.Table, answers: pa.Table, more: list[str]) -> tuple[Tokens, list[dict]]:
    """The tokens of a group and its answers in the order of segments."""
    group, answers = own.drop_columns(more).to_pylist()[0], answers.sort_by("segment").to_pylist()
    if not {r["mark"] for r in answers} <= {group["mark"]}:
        raise ValueError("the rows of the table come in another order each time it is read")
    return Tokens.unpacked(group), answers


def repeatable(df: DataFrame) -> bool:
    """Whether the plan only reads, picks and filters rows, so that each run gives the same order."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    return all(REPEATABLE.match(line.lstrip(" :+-")) for line in lines if line.strip())
