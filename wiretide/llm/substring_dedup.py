"""Substring dedup with prefix-partitioned suffix trees.

Only suffixes at anchors are kept (a sparse suffix tree): in each window of words the 8-gram of least
hash is the anchor, so equal windows have equal anchors at equal offsets, and every window belongs to
one anchor. Suffixes are partitioned by a prefix of variable length, read from the anchor: 8 words where
the group fits memory, else it grows, up to the whole window. Prefixes that occur once lead to no repeat
and are dropped early. A task gets the suffixes of some prefixes, with the words that their windows
reach, and builds their subtrees: suffixes in the order of their words, with the depth of the node where
two neighbours part. Nodes of window depth or more are the repeats.

Beyond the end of a window, where an anchor near its end has too few words to its right, the prefix goes
on to the left of the anchor. So prefixes of equal windows are equal, whatever stands around them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SegmentFilter, cut_segments, free_shuffles, grouped_batches, input_bytes, intern_words, low_bits, materialize, mix64, partitions, per_segment, read_table, segment_bits, small_batches, texts, tidy, word_hashes

#: Words of a window and of the shortest prefix.
WINDOW, PREFIX = 35, 8
#: Bits of the filter of repeated prefixes for each byte of input, its least and largest size, and the
#: size of the filter of prefixes that must grow. A fuller filter costs time, never a repeat.
BITS_PER_BYTE, LEAST_BITS, MOST_BITS, HOT_BITS = 0.05, 1 << 24, 1 << 30, 1 << 23
#: Different suffixes that one prefix may have before it grows, and that a subtree task holds at once
#: (about half a kilobyte each, and some ten times that while it sorts).
MOST_SUFFIXES, HELD = 1_500, 8_000
#: The base of the hashes of word ranges, and its inverse modulo 2**64.
RADIX = 0xD1342543DE82EF95
INVERSE = pow(RADIX, -1, 1 << 64)


def lengths(window: int, prefix: int) -> list[int]:
    """The lengths of prefixes, each half as long again as the one before, up to the window."""
    out = [min(prefix, window)]
    while out[-1] < window:
        out.append(min(window, out[-1] * 3 // 2))
    return out


def owners(grams: np.ndarray, starts: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, anchor of each): grams has a hash for every position that has one.

    The place stands in the last bits of a hash, so that the least of a window names its anchor, the
    first of equals. Minima of longer stretches come from those of half the length.
    """
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(starts[-1])
    x = np.flatnonzero(left >= window)
    if not len(x):
        return x, x
    places = np.uint64((1 << len(grams).bit_length()) - 1)
    least, reach, span = grams & ~places | np.arange(len(grams), dtype=np.uint64), window - prefix + 1, 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return x, (least[x] & places).astype(np.int64)


class Suffixes:
    """The suffixes at anchors of a group of texts: anchor, first of the windows that it stands for, how many."""

    def __init__(self, docs: list[list[bytes]], window: int, prefix: int):
        ids, self.starts, words = intern_words(docs)
        hashes = word_hashes(words)[ids] if len(words) else np.zeros(0, np.uint64)
        self.window = window
        with np.errstate(over="ignore"):
            powers = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), base, np.uint64)]))
            power, self.back = powers(RADIX), powers(INVERSE)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
        at = np.arange(max(0, len(hashes) - prefix + 1))
        x, own = owners(self.range_hash(at, at + prefix), self.starts, window, prefix)
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(x) else x
        self.first_level = (own[new], x[new], np.diff(np.concatenate([new, [len(x)]])))

    def range_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the words from a to b."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[b] - self.sums[a]) * self.back[a])

    def body_hash(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.range_hash(first, first + count - 1 + self.window)

    def keyed(self, level: tuple, length: int) -> tuple:
        """Suffixes whose prefix grows to this length: (anchor, first, count, key).

        Windows with so many words from the anchor on share the prefix; each of the others has its own,
        its last words, told apart by the anchor's place in the window.
        """
        anchor, first, count = level
        with np.errstate(over="ignore"):
            right = np.clip(anchor - (self.window - length), first, first + count)  # windows from here on reach far enough
            near = first + count - right
            own = np.repeat(np.arange(len(anchor)), right - first)
            single = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(right - first) - (right - first), right - first)
            some = near > 0
            shared = mix64(self.range_hash(anchor[some], anchor[some] + length) + np.uint64(length))
            apart = self.range_hash(single + self.window - length, single + self.window) + ((anchor[own] - single + 1).astype(np.uint64) << np.uint64(32)) + np.uint64(length)
        return np.concatenate([anchor[some], anchor[own]]), np.concatenate([right[some], single]), np.concatenate([near[some], np.ones(len(own), np.int64)]), np.concatenate([shared, mix64(apart)])

    def levels(self, hot: list[SegmentFilter], sizes: list[int]) -> Iterator[tuple]:
        """Level by level the suffixes whose shorter prefixes all had to grow, and which of them stay there.

        hot tells which prefixes of a level must grow; where it ends, all of them do.
        """
        level = self.first_level
        for k, size in enumerate(sizes):
            anchor, first, count, key = self.keyed(level, size)
            grows = np.full(len(key), k < len(sizes) - 1) if k >= len(hot) else hot[k].has(key) if len(key) else np.zeros(0, np.bool_)
            yield anchor, first, count, key, ~grows
            level = (anchor[grows], first[grows], count[grows])


def _counted(docs: DataFrame, text: str, window: int, prefix: int, hot: list[SegmentFilter], levels: list[int], most: int, bits: int, each: int) -> list:
    """For each segment of prefix hashes of these levels: bits of the repeated ones, and for each level of those with too many suffixes."""
    sizes = lengths(window, prefix)
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, text):
            suffixes = Suffixes([v.split() for v in texts(table.column(0).combine_chunks())], window, prefix)
            rows = []
            for level, (_, first, n, key, _) in enumerate(suffixes.levels(held.value, sizes[: levels[-1] + 1])):
                if level not in levels or not len(key):
                    continue
                # Equal suffixes of a prefix are one row with a count.
                order = np.lexsort((body := suffixes.body_hash(first, n), key))
                key, body = key[order], body[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (body[1:] != body[:-1])]))
                times, key, body = np.diff(np.concatenate([new, [len(key)]])).astype(np.uint32), key[new], (body[new] >> np.uint64(32)).astype(np.uint32)
                edges, low = cut_segments(key, bits), low_bits(key, bits)
                rows += [(s, level, low[a:b].tobytes(), body[a:b].tobytes(), times[a:b].tobytes()) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["segment", "level", "low", "body", "times"])

    def build(s: int, lists: list) -> pa.RecordBatch:
        again, many = [], []
        for level in sorted(set(lists[0])):
            low, body, times = (np.concatenate([np.frombuffer(x, np.uint32) for x, at in zip(column, lists[0]) if at == level]) for column in lists[1:])
            keys, which = np.unique(low, return_inverse=True)
            again.append(keys[np.bincount(which, times) > 1])
            different = np.unique(which.astype(np.uint64) << np.uint64(32) | body) >> np.uint64(32)
            grows = keys[np.bincount(different.astype(np.int64)) > most]
            if len(grows) and sizes[level] < window:
                many.append({"level": level, "bits": SegmentFilter.build(grows, HOT_BITS >> bits)})
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([SegmentFilter.build(np.concatenate(again), each)], pa.binary()), pa.array([many], pa.list_(pa.struct([("level", pa.int32()), ("bits", pa.binary())])))], names=["segment", "again", "many"])

    counted = docs.select(text).mapInArrow(tidy(count), "segment int, level int, low binary, body binary, times binary")
    return per_segment(counted, build, "segment int, again binary, many array<struct<level:int,bits:binary>>").collect()


def filters(docs: DataFrame, text: str, window: int, prefix: int, most: int, filter_bits: int) -> tuple[SegmentFilter, list[SegmentFilter]]:
    """(the prefixes of two suffixes or more, for each length those with too many different suffixes).

    The first pass counts the shortest prefixes. Where some must grow, a second pass counts the longer
    prefixes of their suffixes, all lengths at once.
    """
    bits, sizes = segment_bits(docs, most=14), lengths(window, prefix)
    again, hot = SegmentFilter([], bits, filter_bits), []
    for levels in ([0], list(range(1, len(sizes)))):
        rows = _counted(docs, text, window, prefix, hot, levels, most, bits, again.each)
        again.array |= SegmentFilter([(r.segment, r.again) for r in rows], bits, filter_bits).array
        many = [(x.level, r.segment, x.bits) for r in rows for x in r.many]
        if not many:
            break
        hot += [SegmentFilter([(s, x) for at, s, x in many if at == level], bits, HOT_BITS) for level in levels]
    return again, hot + [SegmentFilter([], bits, HOT_BITS)] * (len(sizes) - len(hot))


#: Kinds of rows of the last pass over the texts: a document without repeats, one that may have some,
#: and a suffix with the words around it and the places where it stands.
CLEAN, OPEN, SUFFIX = range(3)


def _suffixes(docs: DataFrame, id_col: str, text: str, window: int, prefix: int, again: SegmentFilter, hot: list[SegmentFilter]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((again, hot))
    kind, sizes = docs.schema[id_col].dataType, lengths(window, prefix)
    types = {"kind": pa.int32(), "rid": pa.int64(), "n": pa.int64(), "key": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "count": pa.int32(), "body": pa.binary(), "rids": pa.list_(pa.int64()), "firsts": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, hot = held.value
        number = TaskContext.get().partitionId() << 33
        for table in grouped_batches(batches, text):
            words = [v.split() for v in texts(table.column(1).combine_chunks())]
            suffixes = Suffixes(words, window, prefix)
            is_open, found = np.zeros(len(words), np.bool_), {}
            for _, first, count, key, stays in suffixes.levels(hot, sizes):
                ok = stays & again.has(key) if len(key) else stays
                doc = np.searchsorted(suffixes.starts, first[ok], side="right") - 1
                is_open[doc] = True
                for d, a, n, k in zip(doc.tolist(), (first[ok] - suffixes.starts[doc]).tolist(), count[ok].tolist(), key[ok].view(np.int64).tolist()):
                    body = b" ".join(words[d][a : a + n - 1 + window])
                    found.setdefault((k, n, body), []).append((number + d, a))
            rows = [(OPEN, number + d, len(w), 0, 0, 0, 0, b" ".join(w), None, None) if is_open[d] else (CLEAN, number + d, len(w), 0, 0, 0, 0, hashlib.sha256(b" ".join(w)).hexdigest().encode(), None, None) for d, w in enumerate(words)]
            for (k, n, body), places in found.items():
                digest = hashlib.blake2b(body, digest_size=16, key=b"%d %d" % (k, n)).digest()
                d1, d2 = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
                rows.append((SUFFIX, 0, 0, k, d1, d2, n, body, *zip(*places)))
            ids = table.column(0).combine_chunks().take(pa.array([*range(len(words)), *[None] * len(found)], pa.int64()))
            yield from pa.table([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), types.values()))], names=["id", *types]).to_batches(max_chunksize=10_000)
            number += len(words)

    return docs.select(id_col, text).mapInArrow(tidy(run), f"id {kind.simpleString()}, kind int, rid long, n long, key long, d1 long, d2 long, count int, body binary, rids array<long>, firsts array<int>")


def node_depths(ids: np.ndarray, starts: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Depth of the deepest node above each leaf, in a tree of the suffixes of the bodies.

    ids: words of all bodies; leaves: positions of the suffixes. Suffixes are put in the order of
    their words by prefix doubling; two neighbours part at a node as deep as their common prefix,
    which the names of the doubling give by halving.
    """
    longest = int(np.diff(starts).max(initial=1))
    # Every body ends with a word of its own, so a common prefix never runs over the end.
    ends = starts[1:] + np.arange(len(starts) - 1)
    seq = np.empty(len(ids) + len(ends), np.int64)
    inside = np.ones(len(seq), np.bool_)
    inside[ends] = False
    seq[inside], seq[ends] = ids, int(ids.max(initial=0)) + 1 + np.arange(len(ends))
    at = leaves + np.searchsorted(starts, leaves, side="right") - 1
    names, depth = [seq], 1
    while depth <= longest:
        now = names[-1]
        pairs = now * (now.max() + 2)
        pairs[:-depth] += now[depth:] + 1
        names.append(np.unique(pairs, return_inverse=True)[1])
        depth *= 2
    order = np.argsort(names[-1][at], kind="stable")
    p, q = at[order[:-1]], at[order[1:]]
    common = np.zeros(len(p), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = np.minimum(p + common, len(seq) - 1), np.minimum(q + common, len(seq) - 1)
        common += (names[k][a] == names[k][b]) << k
    out = np.zeros(len(at), np.int64)
    out[order[:-1]] = common
    out[order[1:]] = np.maximum(out[order[1:]], common)
    return out


def repeats(bodies: list[bytes], counts: np.ndarray, copies: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each body the ranges of words under nodes of window depth: counts are its windows, copies the places where it stands."""
    ids, starts, _ = intern_words([x.split(b" ") for x in bodies])
    body = np.repeat(np.arange(len(bodies)), counts)
    leaves = starts[body] + np.arange(len(body)) - np.repeat(np.cumsum(counts) - counts, counts)
    depth = np.where(copies[body] > 1, starts[body + 1] - leaves, node_depths(ids, starts, leaves))
    deep = depth >= window
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, leaves[deep], 1)
    np.add.at(covered, leaves[deep] + depth[deep], -1)
    covered = np.cumsum(covered)[:-1] > 0
    out = []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered[a:b], [False]]).view(np.int8))) if covered[a:b].any() else np.zeros(0, np.int64)
        out.append([tuple(x) for x in edges.reshape(-1, 2).tolist()])
    return out


def _subtrees(suffixes: DataFrame, window: int) -> DataFrame:
    """(d1, d2, spans): for each different suffix the ranges of its words that repeat."""

    def solve(rows: list) -> pa.RecordBatch:
        found = repeats([r[4] for r in rows], np.array([r[3] for r in rows]), np.array([r[5] for r in rows]), window)
        picked = [(r[1], r[2], [{"start": a, "stop": b} for a, b in spans]) for r, spans in zip(rows, found) if spans]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in picked], t) for k, t in enumerate(kinds)], names=["d1", "d2", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:3] == list(row[:3]):
                    held[-1][5] += row[5]  # the same suffix from another group of texts
                    continue
                if len(held) >= HELD and held[-1][0] != row[0]:
                    yield solve(held)
                    held = []
                held.append(list(row))
        if held:
            yield solve(held)

    dealt = suffixes.select("key", "d1", "d2", "count", "body", F.size("rids").alias("copies")).repartition(partitions(suffixes.sparkSession), "key")
    return dealt.sortWithinPartitions("key", "d1", "d2").mapInArrow(tidy(run), "d1 long, d2 long, spans array<struct<start:int,stop:int>>")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, most: int = MOST_SUFFIXES, filter_bits: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): one row per row of docs.

    Words are split at ASCII white space and not changed. A word goes if it lies in a window whose
    words also start elsewhere, in any row of docs; windows are judged on the input. kept: the words
    that stay, joined by one space, null where nothing was removed. Null and empty texts have no words.
    Ids may be null or repeat: rows are told apart by their own numbers, and a repeated row repeats
    its windows. Further columns of any name don't matter. Texts below the window length never lose
    words. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bits = filter_bits or min(MOST_BITS, max(LEAST_BITS, 1 << int(input_bytes(docs) * BITS_PER_BYTE).bit_length()))
    rows = materialize(_suffixes(docs, id_col, text, window, prefix, *filters(docs, text, window, prefix, most, bits)), "suffixes")
    free_shuffles(spark)
    places = rows.filter(F.col("kind") == SUFFIX)
    found = materialize(_subtrees(places, window), "suffix-repeats").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "spans")
    free_shuffles(spark)
    marks = places.select("d1", "d2", "rids", "firsts").join(found, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    marks = marks.select(F.explode(F.arrays_zip("rids", "firsts")).alias("p"), "spans").select(F.col("p.rids").alias("r"), F.transform("spans", lambda x: F.struct((x["start"] + F.col("p.firsts")).alias("start"), (x["stop"] + F.col("p.firsts")).alias("stop"))).alias("spans"))
    spans = marks.groupBy("r").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    opened = rows.filter(F.col("kind") == OPEN).select("id", "rid", "n", "body").join(spans, F.col("rid") == F.col("r"), "left")
    opened = opened.select("id", F.col("n").alias("n_words"), "body", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept = [], [], []
            for n, body, starts, stops in zip(*(c.to_pylist() for c in batch.columns[1:])):
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, starts or [], 1)
                np.add.at(gone, stops or [], -1)
                gone = np.cumsum(gone)[:n] > 0
                left = b" ".join([w for w, g in zip(body.split(b" "), gone.tolist()) if not g]) if starts else body
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if starts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = opened.mapInArrow(tidy(cut), f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    clean = rows.filter(F.col("kind") == CLEAN).select("id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("body").cast("string").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return clean.unionByName(done).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents."""
    return substring_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


#: Windows are counted whole; words are split as the operator splits them.
SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, s, md5_number(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS h FROM p),
r AS (SELECT doc_id, s FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
o AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
f AS (SELECT doc_id, w, gone, CASE WHEN len(gone) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM o)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM f
"""
