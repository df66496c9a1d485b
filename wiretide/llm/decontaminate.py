"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

A text is normalised and scanned once; a hit of half a window is followed to both sides as far as the
words of text and item agree, and what is a window long or longer is mapped back to bytes of the
original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, intern_words, materialize, ngram_hashes, read_table, small_batches, texts, tidy, word_hashes

#: Words of a window.
WINDOW = 10
#: Benchmark text that one automaton holds (about 30 bytes of memory each); a larger benchmark is taken
#: in blocks of that size.
BLOCK_BYTES = 4 << 20
#: Numbers the rows where there are several blocks.
ROW = "row number of the scan"

#: Byte to byte: A-Z in lower case, digits, a-z and all bytes of non-ASCII characters as they are,
#: everything else a space. Lengths don't change, so offsets are those of the original.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def anchor_places(items: list[tuple], window: int = WINDOW) -> list[list[int]]:
    """For each item the places of its anchors: every window holds one of them whole.

    Of all ways to place them the one is taken whose anchors occur least often in all items together, so
    that what templated items have in common is no anchor where a window has anything else.
    """
    size = window - window // 2
    ids, starts, distinct = intern_words([text.translate(FOLD).split() for _, text in items])
    keys, at = ngram_hashes(word_hashes(distinct)[ids], starts, size)
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = np.zeros(len(ids), np.int64)
    often[at] = counts[which]
    out, step = [], window - size + 1
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        n = end - begin - size + 1
        if end - begin < window:
            out.append([0] if end > begin else [])
            continue
        cost, least, back = often[begin : begin + n].tolist(), [], []
        for p in range(n):
            # The anchor before this one is at most `step` places away, and the first one is in the first window.
            before = min(range(max(0, p - step), p), key=least.__getitem__, default=-1)
            if p < step:
                before = -1
            least.append(cost[p] + (least[before] if before >= 0 else 0))
            back.append(before)
        p, chosen = min(range(n - step, n), key=least.__getitem__), []
        while p >= 0:
            chosen.append(p)
            p = back[p]
        out.append(chosen[::-1])
    return out


def automaton(items: list[tuple], window: int = WINDOW, places: list[list[int]] | None = None):
    """An automaton of anchors at the given places: every window of an item holds one of the item's anchors whole.

    An anchor is half a window; an item of fewer words than a window is an anchor itself. Values are
    (words of the anchor, [(number of the item, place in it)]). The automaton has some 5 nodes for each
    word of the items; whole windows would take 75.
    """
    import ahocorasick

    size, found, held = window - window // 2, {}, []
    for k, ((_, text), own) in enumerate(zip(items, places or anchor_places(items, window))):
        words = text.translate(FOLD).split()
        held.append(words)
        for p in own:
            found.setdefault(b" ".join(words if len(words) < window else words[p : p + size]), []).append((k, p))
    machine = ahocorasick.Automaton()
    for anchor, where in found.items():
        machine.add_word(f" {anchor.decode('latin-1')} ", (anchor.count(b" ") + 1, where))
    if found:
        machine.make_automaton()
    return (machine, held) if found else None


def scan(machine, text: bytes, window: int = WINDOW) -> tuple[int, np.ndarray, set[int]]:
    """(words, covered words as a mask or empty, numbers of the items with windows in the text)."""
    words = text.translate(FOLD).split()
    if not words or machine is None:
        return len(words), np.zeros(0, np.bool_), set()
    line = b" " + b" ".join(words) + b" "
    hits = list(machine[0].iter(line.decode("latin-1")))
    if not hits:
        return len(words), np.zeros(0, np.bool_), set()
    ends = np.cumsum([len(w) + 1 for w in words])  # the space after each word
    mask, items, done = np.zeros(len(words), np.bool_), set(), {}
    last = np.searchsorted(ends, [end for end, _ in hits])
    for at, (_, (n, places)) in zip(last.tolist(), hits):
        for k, p in places:
            start, item = at - n + 1, machine[1][k]
            if done.get((k, start - p), 0) > at:
                continue  # this run of equal words was seen from an earlier anchor
            a, b = start, at + 1
            while a and a > start - p and words[a - 1] == item[p - start + a - 1]:
                a -= 1
            while b < len(words) and p + b - start < len(item) and words[b] == item[p + b - start]:
                b += 1
            done[k, start - p] = b
            if b - a >= min(window, len(item)):
                mask[a:b] = True
                items.add(k)
    return len(words), mask, items if mask.any() else set()


def original_spans(text: bytes, mask: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans in the original text of the runs of covered words."""
    if not mask.any():
        return []
    inside = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))]


def _blocks(benchmark: DataFrame, item_col: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, so that the driver and an automaton hold one block at a time."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), size.alias("size"))
    total = items.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else items
        yield [(r.item, bytes(r.text)) for r in part.select("item", "text").collect()]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans): one row per document.

    items: sorted ids (as strings) of the benchmark items with a window in the text. spans: byte
    ranges of the original UTF-8 text that the hit words take. Null texts have no words. Items of no
    words match nothing; those of null id give hits and spans, but no id in items. Rows with null or
    repeated ids are rows of their own: if the benchmark takes more than one block, rows are numbered
    once in the shared folder and blocks are merged by the number. Further columns of any name don't
    matter. An empty benchmark leaves every document clean, no documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = lambda more: f"`{id_col}` {kind}, {''.join(f'`{c}` long, ' for c in more)}n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>, words array<struct<start:long,stop:long>>"

    def scanned(block: list[tuple], rows: DataFrame, more: tuple = ()) -> DataFrame:
        held = spark.sparkContext.broadcast((block, anchor_places(block, window)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, places = held.value
            machine = automaton(items, window, places)
            for batch in batches:
                out = []
                for value in texts(batch.column(1)):
                    n, mask, numbers = scan(machine, value, window)
                    spans = original_spans(value, mask) if numbers else []
                    run_edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2).tolist() if numbers else []
                    out.append((n, int(mask.sum()), sorted({items[k][0] for k in numbers} - {None}), spans, run_edges))
                pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                pairs = lambda x: pa.array([[{"start": a, "stop": b} for a, b in r] for r in x], pair)
                columns = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string())), pairs(columns[3]), pairs(columns[4])], names=[id_col, *more, "n_words", "n_hit", "items", "spans", "words"])

        return rows.select(id_col, text, *more).mapInArrow(tidy(run), schema(more))

    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    first = next(blocks)
    more = next(blocks, None)
    if more is None:
        return scanned(first, docs).drop("words")
    numbered = materialize(docs.select(id_col, text, F.monotonically_increasing_id().alias(ROW)), "scan-rows")
    parts = [materialize(scanned(b, numbered, (ROW,)), "scan-block") for b in (first, more)]
    parts += [materialize(scanned(b, numbered, (ROW,)), "scan-block") for b in blocks]
    discard(numbered)
    return _joined(parts, id_col)


def _joined(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Hits of several blocks put together by the number of the row."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = lambda c: _merge_spans(F.sort_array(F.flatten(F.collect_list(c))))
    out = every.groupBy(ROW).agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), merged("spans").alias("spans"), merged("words").alias("__w"))
    n_hit = F.aggregate("__w", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return out.select(id_col, "n_words", n_hit.alias("n_hit"), "items", "spans")


def _merge_spans(spans):
    """Overlapping spans of a sorted array as one."""
    empty = F.slice(spans, 1, 0)

    def add(done, x):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["stop"]), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, empty, add)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all documents and all benchmark items."""
    out = hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with the hit words cut out of their texts; all rows and other columns as they were.

    Hits are judged on the given texts, so nothing that a cut brings together counts. Null texts stay
    null; rows are told apart by their own numbers, whatever their ids are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = _blocks(benchmark, "item_id", "text", block_bytes)
    first = next(blocks)
    if next(blocks, None) is None:
        return _cut(docs, text, spark.sparkContext.broadcast((first, anchor_places(first))))
    row, number, spans = "row number of the cut", "number of the cut", "spans of the cut"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "scan-docs")
    found = hits(numbered, benchmark, row, text, block_bytes=block_bytes).filter(F.size("spans") > 0)
    found = found.select(F.col(row).alias(number), F.col("spans").alias(spans))
    joined = numbered.join(found, F.col(row) == F.col(number), "left")
    return _cut(joined.select(*docs.columns, spans), text, None).drop(spans)


def _cut(docs: DataFrame, text: str, held) -> DataFrame:
    """Texts without the hits of a block, or without the spans in the last column."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(held.value[0], places=held.value[1]) if held else None
        for batch in batches:
            out, given = [], batch.column(at).is_valid().to_pylist()
            spans = None if held else [[(x["start"], x["stop"]) for x in r or ()] for r in batch.columns[-1].to_pylist()]
            for k, value in enumerate(texts(batch.column(at))):
                left, last = [], 0
                for a, b in spans[k] if spans is not None else original_spans(value, scan(machine, value)[1]):
                    left.append(value[last:a])
                    last = b
                out.append(b"".join([*left, value[last:]]).decode() if given[k] else None)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages leave the texts, the documents stay."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


#: Windows are compared as strings.
SQL = rf"""
WITH w AS (SELECT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, item_id FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM w),
v AS (SELECT DISTINCT item, least({WINDOW}, len(ws)) AS n, array_to_string(ws[p:p + least({WINDOW}, len(ws)) - 1], ' ') AS win
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 2))) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
h AS (SELECT p.doc_id, p.p, v.n, v.item FROM p CROSS JOIN (SELECT DISTINCT n FROM v) s JOIN v ON v.n = s.n AND v.win = array_to_string(p.ws[p.p:p.p + s.n - 1], ' ') WHERE p.p + s.n - 1 <= len(p.ws)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
