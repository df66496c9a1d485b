"""Language-model scoring with a log-frequency Bloom filter.

Counts of n-grams up to ORDER words are quantised on a logarithmic scale; an n-gram of level q is put
into the filter once for each level from 1 to q. A count is read back by probing level after level
until one is missing, and counts of longer n-grams are smoothed with those of shorter ones. The filter
grows with the corpus, so it is never one object: leading hash bits name its segments, each sized by
its own entries, and the n-grams of a group of texts visit the segments by one exchange, in which the
segment is first filled and then probed. Words are looked up exactly on the way, for the base score.
The answers meet the texts again by the number of their group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom_positions, cut_segments, free_shuffles, has_bits, materialize, per_segment, read_table, small_batches, tidy
from .groups import LOW_BITS, OWN, Tokens, layout, low_of, met, pack, read_groups, record_batch, repeatable, text_bytes, unpack
from .labelled import remainder

#: Words of the longest n-gram.
ORDER = 4
#: Bits that a segment of the filter has for each of its entries at least, and probes for an entry.
ROOM, PROBES = 32, 3
#: Counts from BASE**(q-1) on have level q.
BASE, LEVELS = 1.5, 64
#: Weight of the estimate of the next shorter n-gram beside the counts of a context.
BACKOFF = 4.0
#: One document in so many is held out.
FOLDS = 10
#: What a group asks of a segment, what it is answered, and what the texts of the group are.
ASK = "segment long, number long, mark long, n long, m long, a binary, b binary"
ANSWER = ASK + ", c binary, tokens long, types long"


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts, from 1."""
    return 1 + np.floor(np.log(counts.astype(float)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_values() -> np.ndarray:
    """The count that each level stands for: the mean of the counts it can have; level 0 is none."""
    out = np.zeros(LEVELS + 1)
    for q in range(1, LEVELS + 1):
        lo, hi = BASE ** (q - 1), BASE**q
        first, last = math.ceil(lo - 1e-9), math.ceil(hi - 1e-9) - 1
        out[q] = (first + last) / 2 if last >= first else lo
    return out


def _at_level(low: np.ndarray, level: int) -> np.ndarray:
    return low.astype(np.uint64) + (np.uint64(level) << np.uint64(32))


def filled(low: np.ndarray, counts: np.ndarray, room: int = ROOM) -> np.ndarray:
    """A segment of the filter: the bits of the stored keys that have a count."""
    low, level = low[counts > 0], level_of(counts[counts > 0])
    bits = 1 << max(10, (int(level.sum()) * room - 1).bit_length())
    flags = np.zeros(bits, np.bool_)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in bloom_positions(_at_level(low[level >= q], q), bits, PROBES):
            flags[at] = True
    return np.packbits(flags, bitorder="little")


def probe(array: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Level of each stored key in a segment, 0 if it is not there."""
    out, bits = np.zeros(len(low), np.uint8), len(array) * 8
    for a in range(0, len(low), 1 << 17):
        alive = np.arange(a, min(len(low), a + (1 << 17)))
        for level in range(1, LEVELS + 1):
            ok = np.ones(len(alive), np.bool_)
            for at in bloom_positions(_at_level(low[alive], level), bits, PROBES):
                ok &= has_bits(array, at)
            alive = alive[ok]
            if not len(alive):
                break
            out[alive] = level
    return out


def log_probabilities(tokens: Tokens, words: np.ndarray, grams: np.ndarray, trained: int, types: int) -> np.ndarray:
    """log10 probability of each text: the sum over its words and its end, each after the words before.

    words: level of each distinct token; grams: levels of the n-grams that end at each token, a row for
    each length from 2 on. The estimate of an n-gram is its count and BACKOFF times the estimate of the
    next shorter one, over the count of its context and BACKOFF, so that estimates add up to one.
    """
    values = level_values()
    counts = [values[words][tokens.ids], *values[grams]]
    p = (counts[0] + 0.1) / (trained + 0.1 * (types + 1))
    for n in range(2, len(counts) + 1):
        own, context = counts[n - 1], np.concatenate([[0.0], counts[n - 2][:-1]])
        context = np.maximum(context, own > 0)
        p = np.where(tokens.nth >= n - 1, (np.minimum(own, context) + BACKOFF * p) / (context + BACKOFF), p)
    logs = np.where(tokens.nth > 0, np.log10(p), 0.0)
    return np.add.reduceat(logs, tokens.starts[:-1]) if len(logs) else np.zeros(0)


def _asked(batches: Iterator[pa.RecordBatch], each: int, bits: int, order: int) -> Iterator[pa.RecordBatch]:
    """For each group of texts and each segment the distinct words and n-grams, with their counts in learnt rows.

    A frequent n-gram travels once a group. Words go as whole hashes, n-grams as differences of short ones.
    """
    for number, table, tokens in read_groups(batches, True, each):
        learnt = table.column("learnt").to_numpy()[tokens.of]
        by = np.argsort(tokens.hashes)
        words, times = tokens.hashes[by], np.bincount(tokens.ids[learnt & (tokens.nth > 0)], minlength=len(by))[by].astype(np.uint32)
        grams, inside = tokens.grams(order)
        keys, which = np.unique(grams[inside], return_inverse=True)
        counts = np.bincount(which[np.broadcast_to(learnt, inside.shape)[inside]], minlength=len(keys)).astype(np.uint32)
        ends, word_ends, low = cut_segments(keys, bits), cut_segments(words, bits), low_of(keys, bits)
        rows = []
        for s in range(1 << bits):
            a, b, p, q = ends[s], ends[s + 1], word_ends[s], word_ends[s + 1]
            if b > a or q > p:
                question = np.concatenate([np.diff(low[a:b], prepend=np.uint32(0)), counts[a:b], times[p:q]])
                rows.append((s, number, tokens.mark, b - a, q - p, pack(question), pack(np.diff(words[p:q], prepend=np.uint64(0)))))
        yield record_batch(rows, ASK)


def _segment(s: int, columns: list, bits: int, room: int) -> pa.RecordBatch:
    """Fill a segment with all that was asked of it, then probe it for every group."""
    numbers, marks, ns, ms, a, b = columns
    questions = [unpack(x, 2 * n + m, np.uint32) for x, n, m in zip(a, ns, ms)]
    low = np.concatenate([np.cumsum(q[:n], dtype=np.uint32) for q, n in zip(questions, ns)])
    keys, which = np.unique(low, return_inverse=True)
    counts = np.bincount(which, np.concatenate([q[n : 2 * n] for q, n in zip(questions, ns)]), len(keys))
    words, word_which = np.unique(np.concatenate([np.cumsum(unpack(x, m, np.uint64), dtype=np.uint64) for x, m in zip(b, ms)]), return_inverse=True)
    times = np.bincount(word_which, np.concatenate([q[2 * n :] for q, n in zip(questions, ns)]), len(words)).astype(np.int64)
    # Words and n-grams share the segment; a word's key is moved out of the range of the n-grams.
    of_words = low_of(words, bits) | np.uint32(1 << LOW_BITS)
    array = filled(np.concatenate([keys, of_words]), np.concatenate([counts, times]), room)
    level, word_level = probe(array, keys)[which], probe(array, of_words)[word_which]
    found, rows, at, p = times[word_which], [], 0, 0
    for number, mark, n, m in zip(numbers, marks, ns, ms):
        rows.append((s, number, mark, n, m, pack(level[at : at + n]), pack(word_level[p : p + m]), pack(found[p : p + m]), 0, 0))
        at, p = at + n, p + m
    rows[0] = (*rows[0][:-2], int(times.sum()), int((times > 0).sum()))
    return record_batch(rows, ANSWER)


def _solved(own: pa.Table, answers: pa.Table, trained: int, types: int, order: int) -> pa.Table:
    """The rows of one group: its tokens meet the answers of all segments."""
    tokens, answers = met(own, answers, ["ids", "held"])
    every = lambda c, n, kind: np.concatenate([unpack(r[c], r[n], kind) for r in answers])
    grams, inside = tokens.grams(order)
    levels = np.zeros(grams.shape, np.uint8)
    levels[inside] = every("a", "n", np.uint8)[np.unique(grams[inside], return_inverse=True)[1]]
    by = np.argsort(tokens.hashes)
    words, counts = np.empty(len(by), np.uint8), np.empty(len(by), np.int64)
    words[by], counts[by] = every("b", "m", np.uint8), every("c", "m", np.int64)
    count, real = counts[tokens.ids], tokens.nth > 0
    total = lambda x: np.bincount(tokens.of, np.where(real, x, 0), len(tokens.starts) - 1)
    n = total(1).astype(np.int64)
    base = total(np.log10(count + 0.1)) - n * math.log10(trained + 0.1 * (types + 1))
    ids, held = (own.column(c).combine_chunks()[0].values for c in ("ids", "held"))
    return pa.table({"id": ids, "held_out": held, "n_tokens": n, "n_known": total(count > 0).astype(np.int64), "base_score": base, "score": log_probabilities(tokens, words, levels, trained, types)})


def score(docs: DataFrame, learnt: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER, room: int = ROOM) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs.

    The model is learnt from the rows for which `learnt` holds (a null doesn't), and scores all rows. To
    score other texts by a corpus, give the union of both. base_score and n_known use exact counts,
    score the levels read from the filter. Null text is empty: its end is its only token. Ids may be
    null or repeat; further columns of any name don't matter. An empty table gives an empty result, a
    table without learnt rows gives every token the same probability.

    Sizes follow from the counted bytes of the texts (groups.layout), so the same texts have the same scores
    however they are stored; no word or n-gram is moved more than once a group, however frequent it is. The
    texts are read three times, so a table that is more than read and filtered is written first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(learnt, F.lit(False)).alias("learnt"))
    given = given if repeatable(given) else materialize(given, "lm-texts")
    each, bits = layout(text_bytes(given, "text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table, tokens in read_groups(batches, True, each):
            whole = record_batch([tokens.packed(number)], OWN)
            ids, held = pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)), pa.array([[not x for x in table.column("learnt").to_pylist()]])
            yield pa.RecordBatch.from_arrays([*whole.columns, ids, held], names=[*whole.schema.names, "ids", "held"])

    asked = given.mapInArrow(tidy(lambda batches: _asked(batches, each, bits, order)), ASK)
    answers = materialize(per_segment(asked, lambda s, columns: _segment(s, columns, bits, room), ANSWER), "lm-answers")
    free_shuffles(spark)
    trained, types = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    groups = given.mapInArrow(tidy(own), f"{OWN}, ids array<{kind}>, held array<boolean>")
    both = groups.groupBy("number").cogroup(answers.drop("tokens", "types").groupBy("number"))
    out = both.applyInArrow(lambda a, b: _solved(a, b, trained, types, order), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over all documents, learning from those of remainder 1 to 9."""
    return score(read_table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), FOLDS) != 0)
