"""Toxicity by weak supervision.

Many voters look at a text: words of a lexicon, and words and word beginnings that stand out in
labelled rows. A generative model with a latent label estimates how accurate the voters are and which
of them depend on each other (a tree of dependences given the label), and turns their votes into
posterior labels. It sees no labels: accuracies come from how the voters agree. A linear classifier is
trained on these posteriors and scores all texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialize, read_table, small_batches, tidy
from .labelled import SAMPLE_ROWS, remainder, sample

#: Insults in plain use: the lexicon voters, fixed values.
LEXICON = ["clown", "crap", "disgusting", "dumb", "fool", "freak", "garbage", "hate", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "retard", "scum", "shut up", "stupid", "trash", "ugly", "vermin", "worthless"]
#: A voter of level 0 fires if any word matches, one of level 1 if this share of the words match or so
#: many words, one of level 2 if two words at least and twice that share match.
SHARE, COUNT = 0.004, 3
#: Share of toxic rows among those that a voter fires on.
PRECISION = 0.9
#: Lengths of word beginnings, and how many voters there are at most.
BEGIN, VOTERS = range(3, 9), 160
#: Chance, over all candidates, that a voter stands out by luck.
LUCK = 0.01
ROUNDS, RIDGE = 15, 0.05
#: First guess of P(toxic) where no voter fires and where one does.
SILENT, SPOKEN = 0.02, 0.9
FOLDS, REMAINDER, THRESHOLD = 3, 1, 0.7

#: ASCII other than letters becomes a space; other bytes stay.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> bytes:
    """Lower-case text with single-byte non-letters as spaces."""
    return text.lower().encode().translate(LETTERS)


def candidates(text: str) -> list[str]:
    """Voters that would fire on this text: a level, then a word ("word ") or a beginning ("beg")."""
    found = words(text).decode().split()
    counts: Counter = Counter()
    for word, n in Counter(found).items():
        counts[word + " "] += n
        for k in BEGIN:
            if k > len(word):
                break
            counts[word[:k]] += n
    return [f"{level}{c}" for c, n in counts.items() for level in range(level_of(n, n / len(found)) + 1)]


def level_of(count: int, rate: float) -> int:
    """The highest level of voter that so many matches let fire."""
    return 2 if count >= 2 and rate >= 2 * SHARE else int(count >= COUNT or rate >= SHARE)


def mined(rows: DataFrame, voters: int = VOTERS) -> tuple[list[str], float]:
    """Patterns that stand out in toxic rows of (text, y), and the share of toxic rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y != 0].update(candidates(text))
            keys = sorted(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["pattern", "bad", "good"])

    total, bad = rows.agg(F.count(F.lit(1)), F.sum((F.col("y") != 0).cast("long"))).first()
    if not total or not bad or bad == total:
        return [], 0.1
    share = bad / total
    counts = rows.select("text", "y").mapInArrow(tidy(run), "pattern string, bad long, good long").groupBy("pattern").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = F.col("bad") + F.col("good")
    p = F.col("bad") / n
    # Evidence against chance: n times the divergence of the pattern's share from the overall share.
    gain = F.col("bad") * F.log(p / share) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - p) / (1 - share))).otherwise(0)
    # The number of candidates is bounded by the sample; its order of size is enough here.
    needed = math.log(max(2, total) * 400 / LUCK)
    top = counts.filter((p >= PRECISION) & (gain > needed)).select("pattern", "bad", "good", F.round(gain, 6).alias("gain")).orderBy(F.desc("gain"), F.desc(F.length("pattern")), "pattern").limit(20 * voters).collect()
    chosen: list = []
    for row in top:
        word = row.pattern[1:].strip()
        near = [c for c in chosen if c.pattern[1:].startswith(word) or word.startswith(c.pattern[1:].strip())]
        if all(row.bad - c.bad > 0.1 * row.bad + max(0, row.good - c.good) for c in near):
            chosen.append(row)
    return [c.pattern for c in chosen[:voters]], share


class Voters:
    """One automaton for all voters."""

    def __init__(self, voters: list[str]):
        import ahocorasick

        self.voters = list(dict.fromkeys([*voters, *(f"0{w} " for w in LEXICON)]))
        self.of: dict[str, list[tuple[int, int]]] = {}
        for k, voter in enumerate(self.voters):
            self.of.setdefault(voter[1:], []).append((k, int(voter[0])))
        self.machine = ahocorasick.Automaton()
        for pattern in self.of:
            self.machine.add_word(" " + pattern.encode().decode("latin-1"), pattern)
        self.machine.make_automaton()

    def row(self, text: str) -> tuple[list[int], list[float]]:
        """Numbers of the voters with matches, and how strongly each speaks (1 and more: it fires)."""
        line = words(text)
        hits = Counter(p for _, p in self.machine.iter((b" " + line + b" ").decode("latin-1")))
        if not hits:
            return [], []
        n = len(line.split())
        found = sorted((k, strength(c, c / n, level)) for p, c in hits.items() for k, level in self.of[p])
        return [k for k, _ in found], [v for _, v in found]


def strength(count: int, rate: float, level: int) -> float:
    """1 where a voter fires, growing slowly beyond, and less than a half below."""
    if level == 0:
        return 1.0
    reach = max(rate / SHARE, count / COUNT) if level == 1 else min(count / 2, rate / SHARE / 2)
    return 1 + 0.5 * min(2.0, math.log2(reach)) if reach >= 1 else reach * 0.4


def dense(rows: list[tuple[list[int], list[float]]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for at, (ks, vs) in enumerate(rows):
        x[at, ks] = vs
    return x


def posterior(votes: np.ndarray, share: float, rounds: int = ROUNDS, one_sided: bool = False) -> np.ndarray:
    """P(toxic | votes) by EM over a latent label; dependences given the label form a tree.

    A voter that doesn't fire abstains and says nothing, but that none fires at all is evidence. The
    first guess gives the latent label its meaning; `share` is the prior of toxic rows. one_sided: a
    voter that fires never speaks for a clean row. Without that, the rows of one voter can drift to the
    clean side, round by round, and take with them those that differ by their other voters alone.
    """
    n, m = votes.shape
    if not n or not m:
        return np.full(n, share)
    v = votes.astype(float)
    none = ~votes.any(axis=1)
    q = np.where(none, SILENT, SPOKEN)
    parent = np.full(m, -1)
    least = 0.0 if one_sided else -math.inf
    for step in range(rounds):
        if step in (0, rounds // 2):
            parent = dependences(v, q)
        z = np.full(n, math.log(share / (1 - share)))
        sides = [(weight, weight.sum() + 1) for weight in (q, 1 - q)]
        silent = [math.log((weight[none].sum() + 0.5) / total) for weight, total in sides]
        z[none] += silent[0] - silent[1]
        for j in range(m):
            fired, base = votes[:, j], [(weight @ v[:, j] + 0.05) / total for weight, total in sides]
            if parent[j] < 0:
                z[fired] += max(least, math.log(base[0] / base[1]))
                continue
            for state in (False, True):
                at = votes[:, parent[j]] == state
                p = [(weight[at] @ v[at, j] + 2 * b) / (weight[at].sum() + 2) for (weight, _), b in zip(sides, base)]
                z[at & fired] += max(least, math.log(p[0] / p[1]))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q


def dependences(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Parent of each voter in a maximum spanning forest of mutual information given the label."""
    m = v.shape[1]
    info = np.zeros((m, m))
    for weight in (q, 1 - q):
        total = weight.sum() + 1e-9
        both = (v * weight[:, None]).T @ v / total
        one = np.diag(both).copy()
        for a, pa_ in ((1, one), (0, 1 - one)):
            for b, pb in ((1, one), (0, 1 - one)):
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                joint = np.clip(joint, 1e-12, 1)
                info += total / len(v) * joint * np.log(joint / np.clip(np.outer(pa_, pb), 1e-12, 1))
    np.fill_diagonal(info, 0)
    parent, best, to = np.full(m, -1), info[0].copy(), np.zeros(m, int)
    left = np.ones(m, np.bool_)
    left[0] = False
    for _ in range(m - 1):
        k = int(np.argmax(np.where(left, best, -1)))
        if best[k] > 3.0 / max(1, len(v)):
            parent[k] = to[k]
        left[k] = False
        closer = info[k] > best
        best[closer], to[closer] = info[k][closer], k
    return parent


@dataclass
class Linear:
    """Weights for the voters' strengths, last the intercept."""

    voters: list[str]
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regress(x: np.ndarray, target: np.ndarray, share: float, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log(share / (1 - share))
    if not len(x):
        w[:-1] = 4.0
        return w
    full = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = full @ w
        return float(np.logaddexp(0, z).sum() - target @ z + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (target - p) - penalty * w
        hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty + 1e-6)
        delta, scale = np.linalg.solve(hessian, gradient), 1.0
        while scale > 1e-4 and loss(w + scale * delta) > now:
            scale /= 2
        if scale <= 1e-4:
            break
        w += scale * delta
        now, before = loss(w), now
        if before - now < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learnt, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Linear:
    """Voters from a bounded labelled sample, then the label model and the classifier.

    The labels choose the voters and give the share of toxic rows, no more; the classifier's targets are
    the label model's posteriors. Without usable labels only the lexicon votes. Null labels and ids are
    left out, null texts are empty, equal texts with equal labels count once; further columns don't
    matter.
    """
    small_batches(docs.sparkSession)
    # Copies would make every word of a toxic text stand out. The sample is written, as three jobs read it.
    found = materialize(sample(docs, labels, label, learnt, rows=rows).dropDuplicates(["text", "y"]), "toxic-sample")
    picked, share = mined(found)
    names = Voters(picked).voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(names)
        for batch in batches:
            got = [own.row(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float64()))], names=["k", "v"])

    votes = found.select("text").mapInArrow(tidy(run), "k array<int>, v array<double>").toArrow()
    x = dense(sorted(zip(votes.column("k").to_pylist(), votes.column("v").to_pylist())), len(names))
    return Linear(names, regress(x, posterior(x >= 1, share, one_sided=True), share))


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text: str = "text", keep: bool = False, name: str = "score") -> DataFrame:
    """(id, score), or with keep all columns and the score, in a last column of the given name.

    Null text scores as empty text; rows with null or repeated ids are scored too. With keep, a column
    of the name of the score is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    docs = docs if keep else docs.select(id_col, text)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    passed = [k for k in range(len(docs.columns)) if keep or k != at]
    fields = [docs.schema[k] for k in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width = Voters(held.value.voters), len(held.value.voters)
        for batch in batches:
            x = dense([own.row(t or "") for t in batch.column(at).to_pylist()], width)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed), pa.array(held.value.score(x), pa.float64())], names=[*(f.name for f in fields), name])

    return docs.mapInArrow(tidy(run), StructType([*fields, StructField(name, DoubleType())]))


def _learnt():
    return remainder(F.col("doc_id"), FOLDS) != REMAINDER


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over all documents; rows of remainder 1 are never learnt from."""
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, train(docs, read_table(spark, sf_dir, "labels"), _learnt()))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score as toxic go, the others stay as they are, with all their columns.

    Null and empty texts score as empty text; rows with null or repeated ids are judged by their texts.
    """
    model, name = train(docs, read_table(spark, sf_dir, "labels"), _learnt()), "score of the stage"
    return score(docs, model, keep=True, name=name).filter(F.col(name) < THRESHOLD).select(*docs.columns)
