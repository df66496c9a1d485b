"""Runs of words by rolling hashes, over texts that may be cut into pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SHINGLE_WORDS, words

#: Odd bases of the two hashes of a run, with their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: So many digests (16 bytes each) go to all workers; more are joined.
BROADCAST = 2_000_000
DIGEST = "a long, b long"


def word_hashes(text: Column) -> Column:
    """A hash of each word of a text, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def powers(base: int, count: int) -> np.ndarray:
    """base ** k modulo 2**64 for k below count."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def rolled(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of `size` words: differences of prefix sums, each brought to the same power."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = []
    with np.errstate(over="ignore"):
        mixed = hashes ^ (hashes >> np.uint64(29))
        for base, inverse in zip(BASES, INVERSES):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers(base, n), dtype=np.uint64)])
            out.append(((sums[size:] - sums[:-size]) * powers(inverse, n - size + 1)).view(np.int64))
    return out[0], out[1]


@dataclass
class Known:
    """Digests that texts are compared with: sorted by the first half where workers hold them, else a table."""

    table: DataFrame | None
    held: object = None

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        first, second = self.held.value
        low, high = np.searchsorted(first, a), np.searchsorted(first, a, "right")
        out = np.zeros(len(a), np.bool_)
        for step in range(int((high - low).max(initial=0))):  # equal first halves are rare
            rows = np.flatnonzero(low + step < high)
            out[rows] |= second[low[rows] + step] == b[rows]
        return out


def known(digests: DataFrame, limit: int = BROADCAST) -> Known:
    """Distinct digests (a, b), sent to all workers if there are at most `limit`."""
    digests = digests.distinct()
    count = digests.limit(limit + 1).count()
    if count > limit:
        return Known(digests)
    rows = digests.toArrow()
    a, b = (np.asarray(rows.column(k)) for k in range(2))
    order = np.argsort(a, kind="stable")
    return Known(None, digests.sparkSession.sparkContext.broadcast((a[order], b[order])))


RUNS = "key string, block long, at long, a long, b long, edge boolean, hashes array<long>, places array<long>"


def runs(pieces: DataFrame, size: int = SHINGLE_WORDS, among: Known | None = None, edges: bool = False) -> DataFrame:
    """(key, block, at, a, b) for each run of words: pieces are rows (key, block, at, hashes), those of a block together.

    A run begins in one row and goes on in the following ones of its block; at is the row where it begins.
    among: only runs that are known. edges: also the first and last words of each block (edge, hashes,
    places), from which stitched() makes the runs that go on in another block.
    """
    kind = pa.schema([("key", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("edge", pa.bool_()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])
    lookup = among if among is not None and among.held is not None else None

    keep = size - 1

    def border(of: tuple, head: tuple, tail: tuple) -> pa.RecordBatch:
        rows = [{"key": of[0], "block": of[1], "edge": first, "hashes": h.view(np.int64).tolist(), "places": p.tolist()} for first, (h, p) in ((True, head), (False, tail))]
        return pa.RecordBatch.from_pylist(rows, schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        now, head, tail = None, nothing, nothing
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, lists = np.asarray(batch.column(2)), batch.column(3)
            new = np.array([x != y for x, y in zip(zip(keys, blocks), [now, *zip(keys, blocks)])], np.bool_)
            if new[0]:
                if edges and now is not None:
                    yield border(now, head, tail)
                head = tail = nothing
            lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            rows = np.concatenate([np.zeros(len(tail[0]), np.int64), np.repeat(np.arange(len(keys)), lengths)])
            hashes = np.concatenate([tail[0], np.asarray(lists.flatten()).view(np.uint64)])
            places, of = np.concatenate([tail[1], at[rows[len(tail[0]) :]]]), np.cumsum(new)[rows]
            a, b = rolled(hashes, size)
            good = of[: len(a)] == of[keep:]
            if lookup:
                good &= lookup.has(a, b)
            hits = np.flatnonzero(good)
            if len(hits):
                none = pa.nulls(len(hits), pa.list_(pa.int64()))
                columns = [batch.column(0).take(pa.array(rows[hits])), batch.column(1).take(pa.array(rows[hits])), pa.array(places[hits]), pa.array(a[hits]), pa.array(b[hits]), pa.nulls(len(hits), pa.bool_()), none, none]
                yield pa.RecordBatch.from_arrays(columns, schema=kind)
            starts = np.flatnonzero(new)
            for k in [*starts, len(keys)] if edges else ():
                # The words of each block that ends in this batch; the last one may go on.
                begin = max((s for s in starts if s < k), default=0)
                inside = np.flatnonzero((rows >= begin) & (rows < k))
                if k and len(head[0]) < keep:
                    head = hashes[inside[:keep]], places[inside[:keep]]
                if 0 < k < len(keys):
                    yield border((keys[begin], blocks[begin]), head, (hashes[inside[-keep:]], places[inside[-keep:]]))
                    head = nothing
            last = np.flatnonzero(of == np.cumsum(new)[-1])[-keep:]
            now, tail = (keys[-1], blocks[-1]), (hashes[last], places[last])
        if edges and now is not None:
            yield border(now, head, tail)

    found = pieces.select(F.col("key").cast("string"), F.col("block").cast("long"), F.col("at").cast("long"), "hashes").mapInArrow(run, RUNS)
    return found if among is None or lookup else _joined(found, among.table)


def _joined(found: DataFrame, table: DataFrame) -> DataFrame:
    """Runs that a table of digests has; edges stay."""
    hits = found.filter("edge is null").join(table, ["a", "b"], "left_semi").select(*found.columns)
    return hits.unionByName(found.filter("edge is not null"))


def stitched(found: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """The runs of runs(..., edges=True) that begin in one block and go on in another, as (key, block, at, a, b).

    A key's edges are a few words for each block; they are followed in order, one after the other.
    """
    kind = pa.schema([("key", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carry = None, []
        for batch in batches:
            out = []
            for key, block, hashes, places, lasts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, carry = key, []
                words = [*carry, *((h, block, p) for h, p in zip(hashes, places))]
                a, b = rolled(np.array([w[0] for w in words], np.int64).view(np.uint64), size)
                out += [(key, words[k][1], words[k][2], int(a[k]), int(b[k])) for k in range(min(len(carry), len(a)))]
                last = [(h, block, p) for h, p in zip(lasts, ends)]
                # A block of few words is all in its last ones, so earlier words may go on behind it.
                carry = ([*carry, *last] if len(hashes) < size - 1 else last)[-(size - 1) :]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kind.types)], schema=kind)

    pair = lambda side: F.max(F.when(F.col("edge") == side, F.struct("hashes", "places")))
    blocks = found.filter("edge is not null").groupBy("key", "block").agg(pair(True).alias("head"), pair(False).alias("tail"))
    ordered = blocks.repartition("key").sortWithinPartitions("key", "block")
    return ordered.select("key", "block", "head.hashes", "head.places", F.col("tail.hashes").alias("lasts"), F.col("tail.places").alias("ends")).mapInArrow(run, f"key string, block long, at long, {DIGEST}")
