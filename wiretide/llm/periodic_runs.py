"""Periodic run detection by Kolpakov and Kucherov, over the words of a text.

A run is a stretch of words with a period that no neighbour continues. The text is cut into factors, each
the longest stretch that also begins earlier (or one new word), by a walk through its suffix automaton.
Runs that touch a border of two factors are found there by Main's algorithm: longest common extensions to
both sides for each period, from two Z functions. A run that lies strictly inside a factor is a copy of a
run in the earlier occurrence of that factor and is copied from there.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import intern_words, mix64, read_table, small_batches, texts, tidy

#: A run has so many words and so many periods at least.
LEAST, TIMES = 24, 3
RUNS = "array<struct<start:long,length:long,period:long>>"


def factorise(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence or -1) of the factors, one after the other."""
    step, link, depth, first = [{}], [-1], [0], [-1]
    last = 0
    for at, word in enumerate(words):
        new = len(step)
        step.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        first.append(at)
        state = last
        while state >= 0 and word not in step[state]:
            step[state][word] = new
            state = link[state]
        if state >= 0:
            target = step[state][word]
            if depth[target] == depth[state] + 1:
                link[new] = target
            else:
                twin = len(step)
                step.append(step[target].copy())
                link.append(link[target])
                depth.append(depth[state] + 1)
                first.append(first[target])
                while state >= 0 and step[state].get(word) == target:
                    step[state][word] = twin
                    state = link[state]
                link[target] = link[new] = twin
        last = new
    out, at, total = [], 0, len(words)
    while at < total:
        state = length = 0
        while at + length < total:
            following = step[state][words[at + length]]
            if first[following] - length >= at:  # its first occurrence is no earlier one
                break
            state, length = following, length + 1
        out.append((at, length, first[state] - length + 1) if length else (at, 1, -1))
        at += length or 1
    return out


def common_prefixes(x: list[int]) -> list[int]:
    """The Z function: how many elements at each place agree with the beginning."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for k in range(1, n):
        same = min(z[k - left], right - k) if k < right else 0
        while k + same < n and x[k + same] == x[same]:
            same += 1
        if k + same > right:
            left, right = k, k + same
        z[k] = same
    return z


def crossing(words: list[int], border: int, before: int, after: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, a period) of the runs that touch a border of factors of `before` and `after` words.

    A run that ends in the right factor begins less than a period before the left factor: else the left
    factor would have been longer. So twice the left factor and once the right one are far enough.
    """
    x = words[max(0, border - 2 * before - after) : border]
    y = words[border : border + after]
    a, b = len(x), len(y)
    ahead = common_prefixes([*y, -1, *x, *y])
    behind = common_prefixes([*x[::-1], -1, *y[::-1], *x[::-1]])
    found = [(border - behind[a + 1 + b - p], border + p + (ahead[p] if p < b else 0), p) for p in range(1, b + 1)]
    found += [(border - p - (behind[p] if p < a else 0), border + ahead[b + 1 + a - p], p) for p in range(1, a + 1)]
    for start, end, p in found:
        if end - start < max(least, times * p):
            continue
        # What the window has cut off is met whole at another border.
        if (start == 0 or words[start - 1] != words[start - 1 + p]) and (end == len(words) or words[end] != words[end - p]):
            yield start, end, p


def find_runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of `least` words and `times` periods, by start, then period.

    times is 2 at least. Words are any equal or different integers from 0 on; no words, no runs.
    """
    periods: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []

    def take(start: int, end: int, period: int) -> None:
        if (start, end) not in periods:
            insort(order, (start, end))
            periods[start, end] = period
        elif period < periods[start, end]:
            periods[start, end] = period

    factors = factorise(words)
    before = 0
    for at, length, source in [*factors, (len(words), 0, -1)]:
        # A run between the two factors is shorter than twice both together.
        if at and 2 * (before + length) > least:
            for run in crossing(words, at, before, length, least, times):
                take(*run)
        if source >= 0 and length >= least + 2:
            shift, k = at - source, bisect_left(order, (source + 1, 0))
            while k < len(order) and order[k][0] < source + length:
                start, end = order[k]
                if end < source + length:
                    take(start + shift, end + shift, periods[start, end])
                k += 1
        before = length
    return sorted((start, end - start, p) for (start, end), p in periods.items())


def may_have_runs(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Whether each text has a stretch of words twice that every text with a run has twice.

    A run of period q and length at least max(least, times * q) agrees with itself q words on, over
    so many words at least; texts without such a repeat are not factorised, as they have no run.
    """
    stretch = min(max(least, times * q) - q for q in range(1, least + 1))
    span = 1 << (stretch.bit_length() - 1)
    h, width = mix64(ids.astype(np.uint64) + np.uint64(1)), 1
    while width < span:
        with np.errstate(over="ignore"):
            h = mix64(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]) if len(h) > width else h[:0]
        width *= 2
    lengths = np.diff(starts)
    of = np.repeat(np.arange(len(lengths)), lengths)[: len(h)]
    inside = np.repeat(starts[1:], lengths)[: len(h)] - np.arange(len(h)) >= span
    h, of = h[inside], of[inside]
    with np.errstate(over="ignore"):
        key = np.sort((h & ~np.uint64(0xFFFF)) ^ (of.astype(np.uint64) << np.uint64(48)) | of.astype(np.uint64) & np.uint64(0xFFFF))
    twice = key[1:][key[1:] == key[:-1]] & np.uint64(0xFFFF)
    out = np.zeros(len(lengths), np.bool_)
    out[twice.astype(np.int64)] = True
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, alter: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) for each row of docs.

    runs: array of (start, length, period) in words, by start, then period. collapsed: the words but those
    that a run contains after its first period, joined by one space. alter(id, words), if given, says
    which words take the place of a text's own. Null and empty texts have no words and no runs; repeated rows
    and ids are rows of their own; null ids stay null; an empty table gives an empty result. Other
    columns don't matter. Nothing is shuffled: a text is searched by one task, in memory of some hundred bytes a
    word.
    """
    small_batches(docs.sparkSession)
    kind = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            found = [x.split() for x in texts(batch.column(1))]
            if alter:
                found = [alter(key, words) for key, words in zip(keys, found)]
            ids, starts, _ = intern_words(found)
            rows, kept = [[] for _ in keys], []
            for k in np.flatnonzero(may_have_runs(ids, starts, least, times)):
                rows[k] = find_runs(ids[starts[k] : starts[k + 1]].tolist(), least, times)
            for words, runs in zip(found, rows):
                if runs:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in runs:
                        drop[start + period] += 1
                        drop[start + length] -= 1
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]))
                else:
                    kept.append(b" ".join(words))
            runs = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.diff(starts)), pa.array(runs, kind.field("runs").type), pa.array(kept, pa.binary())], schema=kind)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"id long, n_words long, runs {RUNS}, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def highest(runs: str = "runs") -> Column:
    """The run of greatest exact length / period, the first of equals; null where there is none."""
    better = "best is null or run.length * best.period > best.length * run.period"
    return F.expr(f"aggregate({runs}, cast(null as struct<start:long,length:long,period:long>), (best, run) -> if({better}, run, best))")


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's texts: one id in ten goes on periodically from some word on; rows without id stay."""
    h = None if key is None else zlib.crc32(str(key).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over all documents."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), alter=planted).withColumn("best", highest())
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
