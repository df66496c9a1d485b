"""Periodic runs, near duplicates among embeddings, centroids: against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretide.llm import centroids, lattice, periodic_runs

VECTORS = "vec_id long, embedding array<double>, label int"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


# -- periodic runs


def plain_runs(w, least, times):
    """Every period on its own: stretches that agree with themselves one period on."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


def odd_words(r, kind):
    n = r.randrange(1, 160)
    if kind == 0:
        return [r.randrange(2) for _ in range(n)]
    if kind == 1:
        w = []
        while len(w) < n:
            w += ([r.randrange(3) for _ in range(r.randrange(1, 9))] * r.randrange(1, 12))[: r.randrange(1, 90)]
        return w
    if kind == 2:
        w = [r.randrange(4) for _ in range(r.randrange(1, 30))] * r.randrange(1, 8)
        w[r.randrange(len(w))] = 9
        return w + w[: r.randrange(len(w))] + w
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b


@pytest.mark.parametrize("least, times", [(24, 3), (2, 2), (6, 3), (4, 2)])
def test_runs_are_those_of_a_plain_search(least, times):
    r = random.Random(least)
    for k in range(1200):
        w = odd_words(r, k % 4)
        want = plain_runs(w, least, times)
        assert periodic_runs.find_runs(w, least, times) == want
        ids = np.array(w + [7, 8, 9], np.uint32)
        may = periodic_runs.may_have_runs(ids, np.array([0, len(w), len(w) + 3]), least, times)
        assert may[0] or not want


def test_factors_are_longest_earlier_stretches():
    r = random.Random(3)
    for _ in range(200):
        w = [r.randrange(3) for _ in range(r.randrange(1, 40))]
        at = 0
        for start, length, source in periodic_runs.factorise(w):
            longest = max((n for n in range(1, len(w) - start + 1) if any(w[s : s + n] == w[start : start + n] for s in range(start))), default=0)
            assert start == at and length == max(1, longest) and (source < 0) == (longest == 0)
            assert source < 0 or source < start and w[source : source + length] == w[start : start + length]
            at += length
        assert at == len(w)


def plain_row(key, text):
    words = [] if text is None else text.encode().split()
    h = None if key is None else zlib.crc32(str(key).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words, 24, 3)
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    shown = "".join(f"{i},{length},{q}\n" for i, length, q in runs)
    left = b" ".join(x for k, x in enumerate(words) if k not in gone)
    return key, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def test_periodic_runs_of_documents(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, " ".join(f"w{x}" for x in odd_words(r, k % 4))) for k in range(400)]
    rows += [(None, "a b " * 40), (None, None), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "é ü\x0b" * 30), (9, "é ü\x0b" * 30), (1010, "long " * 60_000), (1011, " ".join(f"x{k % 4001}" for k in range(50_000)))]
    docs = table(spark, rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "id", "n_words", "collapsed", "best")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.query(spark, str(tmp_path))
    short = [x for x in rows if x[0] not in (1010, 1011)]
    same([tuple(x) for x in got.filter("doc_id is null or doc_id not in (1010, 1011)").collect()], [plain_row(*x) for x in short])
    wide = {x.doc_id: x for x in periodic_runs.periodic_runs(docs).filter("doc_id in (1010, 1011)").collect()}
    assert [tuple(x) for x in wide[1010].runs] == [(0, 60_000, 1)] and wide[1010].collapsed == "long"
    assert [tuple(x) for x in wide[1011].runs] == [(0, 50_000, 4001)]
    assert periodic_runs.periodic_runs(table(spark, [], "doc_id long, text string")).count() == 0


# -- near duplicates among embeddings


def plain_links(rows, threshold):
    groups, out = {}, [[0, r[0]] for r in rows]
    for k, (_, x, label) in enumerate(rows):
        if label is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x):
            groups.setdefault((label, len(x)), []).append(k)
    for ks in groups.values():
        x = np.array([rows[k][1] for k in ks])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        links = x @ x.T / np.outer(norm, norm) >= threshold
        np.fill_diagonal(links, False)
        todo = set(range(len(ks)))
        while todo:
            reached, edge = set(), {todo.pop()}
            while edge:
                reached |= edge
                edge = {int(b) for a in edge for b in np.flatnonzero(links[a])} - reached
            todo -= reached
            ids = [rows[ks[a]][0] for a in reached if rows[ks[a]][0] is not None]
            for a in reached:
                out[ks[a]] = [int(links[a].sum()), min(ids, default=None)]
    return [(r[0], n, c, r[0] == c) for r, (n, c) in zip(rows, out)]


def near_vectors(groups=60, seed=3):
    random = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = random.normal(size=64)
        c /= np.linalg.norm(c)
        for _ in range(int(random.integers(1, 14))):
            w = random.normal(size=64)
            w -= (w @ c) * c
            a = random.choice([0.99, 0.965, 0.95, 0.94])
            x = (a * c + np.sqrt(1 - a * a) * w / np.linalg.norm(w)) * random.choice([1, 3.5])
            rows.append((len(rows), x.tolist(), int(random.integers(0, 2)) if g % 2 else 1))
    return rows


@pytest.mark.parametrize("part", [2048, 8])
def test_near_duplicates(spark, part):
    rows = near_vectors()
    one = rows[0][1]
    rows += [(900, [0.0] * 64, 1), (901, None, 1), (902, [1.0] * 63 + [float("nan")], 1), (903, [1.0] * 63 + [None], 1), (904, [], 1), (905, one, None), (913, [float("inf")] + one[1:], 1)]
    rows += [(906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (None, [2.0, 4.0], 1), (906, [1.0, 2.1], 1), (None, None, None), (None, [9.0] * 5, 3), (914, [1e-300] * 64, 9), (915, [1e300] * 64, 9)]
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(40)]
    vectors = table(spark, rows, VECTORS).withColumns({c: F.lit(1) for c in ("id", "node", "cell", "key", "weight", "vector")})
    got = lattice.near_duplicates(vectors, part=part)
    same([tuple(x) for x in got.collect()], plain_links(rows, 0.93))


def test_near_duplicates_of_nothing(spark):
    assert lattice.near_duplicates(table(spark, [], VECTORS)).count() == 0
    alone = table(spark, [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, None, 1)], VECTORS)
    same([tuple(x) for x in lattice.near_duplicates(alone).collect()], [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)])


def test_decoding_finds_the_nearest_lattice_point():
    random = np.random.default_rng(1)
    y = random.normal(size=(2000, 8)) * 1.5
    near = lattice.decode(y)
    assert len(lattice.ROOTS) == 240 and set((lattice.ROOTS**2).sum(axis=1)) == {8}
    assert (near.sum(axis=1) % 4 == 0).all() and all(len(set(x % 2)) == 1 for x in near)
    own = ((y - near / 2) ** 2).sum(axis=1)
    # A point is the nearest one exactly if no shortest vector leads to a nearer one.
    assert all((own <= ((y - (near + m) / 2) ** 2).sum(axis=1) + 1e-12).all() for m in lattice.ROOTS) and (own <= 1 + 1e-12).all()


@pytest.mark.parametrize("cosine, least", [(0.93, 0.999), (0.95, 0.9998)])
def test_recall_of_the_tables(cosine, least):
    random = np.random.default_rng(2)
    u = lattice.directions(random.normal(size=(8000, 64)))
    w = random.normal(size=u.shape)
    w = lattice.directions(w - (w * u).sum(axis=1, keepdims=True) * u)
    v = cosine * u + np.sqrt(1 - cosine**2) * w
    tables = lattice.Tables(64, lattice.TABLES, lattice.VISITS, lattice.STRETCH)
    of, met = np.zeros(len(u), np.int64), np.zeros(len(u), np.bool_)
    for t in range(lattice.TABLES):
        a, b = tables.cells(u, of, t), tables.cells(v, of, t)
        met |= (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert met.mean() >= least


def test_edges_span_what_links_connect():
    random = np.random.default_rng(5)
    for n in (1, 5, 60):
        links = random.random((n, n)) < 1.2 / n
        links |= links.T
        np.fill_diagonal(links, False)
        first, other = lattice.spanning(links)
        reach = np.linalg.matrix_power(links.astype(float) + np.eye(n), n) > 0
        label = np.arange(n)
        label[other] = first
        assert ((label[:, None] == label) == reach).all()


# -- centroids


def plain_clusters(rows, k=8, rounds=10, width=64):
    import math

    kept = [(i, [math.floor(1024 * c) for c in x]) for i, x in rows if x is not None and len(x) == width and all(c is not None and math.isfinite(c) for c in x)]
    ranked = sorted(kept, key=lambda v: (v[0] is None, hashlib.sha256(f"3:{v[0]}".encode()).hexdigest(), v[1]))
    now = [v for _, v in ranked[:k]]
    give = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        of = [give(v)[1] for _, v in kept]
        for n in range(len(now)):
            own = [v for (_, v), o in zip(kept, of) if o == n]
            if own:
                now[n] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *give(v)[::-1]) for i, v in kept]
    each = {n: sum(d for _, m, d in last if m == n) for n in range(len(now))}
    return [(i, n, d, each[n], sum(each.values()), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for i, n, d in last]


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_centroids(spark, spread, tmp_path):
    random = np.random.default_rng(6)
    rows = [(k, (random.integers(-2, 3, 64) * spread).tolist()) for k in range(150)]
    rows += [rows[0], rows[1], (0, rows[5][1]), (None, rows[7][1]), (None, rows[8][1]), (200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]), (203, [float("inf")] * 64), (204, []), (205, [-0.0] * 64)]
    vectors = table(spark, rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "units", "cluster", "number", "distance")})
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    same([tuple(x) for x in centroids.query(spark, str(tmp_path)).collect()], plain_clusters(rows))


def test_centroids_of_few_and_of_nothing(spark):
    rows = [(k, [float(k)] * 64) for k in range(3)]
    got = centroids.cluster(table(spark, rows, "vec_id long, embedding array<double>")).collect()
    assert {r.distance for r in got} == {0} and len({r.cluster for r in got}) == 3
    assert centroids.cluster(table(spark, [], "vec_id long, embedding array<double>")).count() == 0
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(table(spark, [(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_the_annulus_leaves_centroids_out_and_misses_no_tie():
    random = np.random.default_rng(7)
    c = random.integers(-50, 50, (200, 4)) * np.arange(1, 201)[:, None]
    c[100:110] = c[90:100]
    x = c[random.integers(0, 200, 500)] + random.integers(-30, 30, (500, 4))
    of, d, compared = centroids.Annulus(c.tolist()).nearest(x)
    every = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (of == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all() and compared < 0.5 * every.size
