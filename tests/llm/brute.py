"""Plain versions of the text operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def exact_dedup(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha(t)) for i in ids]
    return out


def line_dedup(rows, ratio, least):
    """rows: (id, host, text)."""
    pages, count = collections.Counter(), collections.Counter()
    for _, h, t in rows:
        pages[h] += 1
        count.update({(h, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in count.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, h, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if (h, x.strip(" ")) not in bad]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lm(rows):
    """Counts and base scores; rows: (id, text)."""
    docs = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, ws in docs if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    scale = n + 0.1 * (v + 1)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / scale) for w in ws)) for i, ws in docs]


def lm_scores(rows, learnt, order, base=1.5, backoff=4.0):
    """Scores from exact counts, each replaced by the mean of the counts of its level."""
    docs = [(i, [b" ", *(t or "").encode().lower().split(), b" "]) for i, t in rows]
    count = collections.Counter()
    for i, w in docs:
        if learnt(i):
            count.update(tuple(w[a - n + 1 : a + 1]) for a in range(1, len(w)) for n in range(1, order + 1) if a - n + 1 >= 0)

    def level(c):
        if not c:
            return 0.0
        q = math.floor(math.log(c) / math.log(base) + 1e-9)
        own = [k for k in range(math.ceil(base**q - 1e-9), math.ceil(base ** (q + 1) - 1e-9))]
        return (own[0] + own[-1]) / 2

    total = sum(c for g, c in count.items() if len(g) == 1)
    scale = total + 0.1 * (sum(len(g) == 1 for g in count) + 1)
    out = []
    for i, w in docs:
        logs = 0.0
        for a in range(1, len(w)):
            p = (level(count[w[a],]) + 0.1) / scale
            for n in range(2, min(order, a + 1) + 1):
                own, before = level(count[tuple(w[a - n + 1 : a + 1])]), level(count[tuple(w[a - n + 1 : a])])
                before = max(before, float(own > 0))
                p = (min(own, before) + backoff * p) / (before + backoff)
            logs += math.log10(p)
        out.append((i, len(w) - 1, logs))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows, items, window=10):
    low = lambda t: WORD.findall((t or "").encode().lower().decode())
    where = collections.defaultdict(set)
    for k, t in items:
        ws = low(t)
        for a in range(max(1, len(ws) - window + 1)) if ws else ():
            where[tuple(ws[a : a + window])].add(str(k))
    sizes = {len(w) for w in where}
    out = []
    for i, t in rows:
        ws, hit, found = low(t), set(), set()
        for n in sizes:
            for a in range(len(ws) - n + 1):
                if got := where.get(tuple(ws[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= got
        out.append((i, len(ws), len(hit), sorted(found)))
    return out


def jaccard(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            common = len(s & sets[b])
            if common and 100 * common >= percent * (len(s) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), 1 << 60), i)
    return [(i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(rows)]


def substrings(rows, window=35):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[a : a + window]) for _, w in docs for a in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def label_model(rows, share, rounds, silent, spoken, forest):
    """P(label) of rows of votes by EM, one row and voter at a time; forest(posteriors) gives each voter's parent."""
    q = [spoken if any(r) else silent for r in rows]
    for step in range(rounds):
        if step in (0, rounds // 2):
            parent = forest(q)
        odds = []
        for r in rows:
            z = math.log(share / (1 - share))
            for sign, w in ((1, q), (-1, [1 - x for x in q])):
                total = sum(w) + 1
                if not any(r):
                    z += sign * math.log((sum(x for x, o in zip(w, rows) if not any(o)) + 0.5) / total)
                for j, fired in enumerate(r):
                    if not fired:
                        continue
                    base = (sum(x for x, o in zip(w, rows) if o[j]) + 0.05) / total
                    if parent[j] >= 0:
                        alike = [(x, o) for x, o in zip(w, rows) if o[parent[j]] == r[parent[j]]]
                        base = (sum(x for x, o in alike if o[j]) + 2 * base) / (sum(x for x, _ in alike) + 2)
                    z += sign * math.log(base)
            odds.append(z)
        q = [1 / (1 + math.exp(-max(-30, min(30, z)))) for z in odds]
    return q
