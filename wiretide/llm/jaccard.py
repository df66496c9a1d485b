"""N-gram Jaccard join: a size-aware heavy-light join over word shingles.

Light (small) sets enumerate their subsets of the sizes that an intersection can have: two linked sets
have their intersection in common. Heavy sets scan the inverted lists of their rarest shingles. The
boundary between the two is where enumerating costs as much as scanning. Before that, documents learn
by an exchange in how many documents each of their shingles occurs: most have too many shingles of
their own to link at all, the others become classes of equal sets.

Only the components of links are wanted, so lists are not multiplied out: classes that a list's hub
gathers are compared with each other in parts of bounded size, and a list whose members hang together
needs no more. Pairs of a list that are still apart then are verified one by one.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_segments, discard, free_shuffles, materialize, mix64, per_segment, read_table, small_batches, tidy
from .components import components
from .groups import OWN, Tokens, layout, low_of, met, pack, read_groups, record_batch, repeatable, text_bytes, unpack

#: Sizes in one cell of a list differ by less than this factor.
STEP = 1.05
#: Members that a task compares with each other at once; a hub with more is dealt to several. Columns of
#: the matrices in which it does so.
PART, COLUMNS = 128, 8192
#: Keys of a class in the first gathering.
SOME = 4
#: Rounds of hubs go on while the pairs that are left number more than this times the members, and halve.
FEW = 32
ASK = "segment long, number long, mark long, n long, a binary"
ANSWER = ASK + ", lists long, total long"


def need(n: int, percent: int) -> int:
    """The least intersection that a set of n shingles can have with a set that it links to."""
    return -(-n * percent // 100)


def shingles(tokens: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the shingles, repeated ones too; a document of fewer words than k has one."""
    grams, inside = tokens.grams(k)
    lengths = np.diff(tokens.starts)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    last = tokens.starts[short + 1] - 1
    whole = np.where(lengths[short] == 1, tokens.hashes[tokens.ids[last]], grams[lengths[short] - 2, last])
    return np.concatenate([tokens.of[inside[k - 2]], short]), np.concatenate([grams[k - 2][inside[k - 2]], whole])


def _asked(batches: Iterator[pa.RecordBatch], each: int, bits: int, k: int) -> Iterator[pa.RecordBatch]:
    """For each group of texts and each segment the distinct shingles, and how often they occur."""
    for number, _, tokens in read_groups(batches, False, each):
        keys, counts = np.unique(shingles(tokens, k)[1], return_counts=True)
        ends, low, counts = cut_segments(keys, bits), low_of(keys, bits), counts.astype(np.uint32)
        rows = [(s, number, tokens.mark, b - a, pack(np.concatenate([np.diff(low[a:b], prepend=np.uint32(0)), counts[a:b]]))) for s, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        if rows:
            yield record_batch(rows, ASK)


def _segment(s: int, columns: list) -> pa.RecordBatch:
    """To each group how often its shingles occur, which bounds their lists: 8 * log2, so 0 for a single time."""
    numbers, marks, ns, a = columns
    questions = [unpack(x, 2 * n, np.uint32) for x, n in zip(a, ns)]
    keys, which = np.unique(np.concatenate([np.cumsum(q[:n], dtype=np.uint32) for q, n in zip(questions, ns)]), return_inverse=True)
    length = np.bincount(which, np.concatenate([q[n:] for q, n in zip(questions, ns)]), len(keys))
    level = np.minimum(255, np.ceil(8 * np.log2(length))).astype(np.uint8)[which]
    cuts = np.cumsum([0, *ns])
    rows = [(s, number, mark, n, pack(level[c : c + n]), 0, 0) for number, mark, n, c in zip(numbers, marks, ns, cuts)]
    rows[0] = (*rows[0][:-2], int((length > 1).sum()), int(length[length > 1].sum()))
    return record_batch(rows, ANSWER)


def _solved(own: pa.Table, answers: pa.Table, k: int, percent: int) -> pa.Table:
    """(id, n, z, digest, items) of the documents of a group: items, rarest first, z of them in no other document."""
    tokens, answers = met(own, answers, ["ids"])
    of, keys = shingles(tokens, k)
    keys, which = np.unique(keys, return_inverse=True)
    levels = np.concatenate([np.zeros(0, np.uint8), *(unpack(r["a"], r["n"], np.uint8) for r in answers)]).astype(np.int64)
    # A document's shingle as one number, so that plain sorts do; the numbers of shingles follow their hashes.
    width = max(1, len(keys))
    pairs = np.sort(of * width + which)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    of, which = pairs // width, pairs % width
    n = np.bincount(of, minlength=len(tokens.starts) - 1)
    z = np.bincount(of, levels[which] == 0, len(n)).astype(np.int64)
    live = (n > 0) & (n - z >= -(-n * percent // 100))
    of, which = of[live[of]], which[live[of]]
    ordered = keys[np.sort((of * 256 + levels[which]) * width + which) % width]
    ends = np.cumsum(np.where(live, n, 0))
    items = [ordered[b - c : b].tobytes() if ok else None for b, c, ok in zip(ends.tolist(), n.tolist(), live.tolist())]
    digests = [None if x is None else hashlib.md5(x).digest() for x in items]
    return pa.table({"id": own.column("ids").combine_chunks()[0].values, "n": n, "z": z, "digest": pa.array(digests, pa.binary()), "items": pa.array(items, pa.binary())})


def _sets(docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> tuple[DataFrame, float]:
    """(id, n, z, digest, items) of every document, items only where it can link at all; the mean length of a list."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    given = given if repeatable(given) else materialize(given, "jaccard-texts")
    each, bits = layout(text_bytes(given, "text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table, tokens in read_groups(batches, False, each):
            whole = record_batch([tokens.packed(number)], OWN)
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type))], names=[*whole.schema.names, "ids"])

    asked = given.mapInArrow(tidy(lambda batches: _asked(batches, each, bits, k)), ASK)
    answers = materialize(per_segment(asked, _segment, ANSWER), "jaccard-lists")
    free_shuffles(spark)
    lists, total = answers.agg(F.coalesce(F.sum("lists"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    both = given.mapInArrow(tidy(own), f"{OWN}, ids array<{kind}>").groupBy("number").cogroup(answers.drop("lists", "total").groupBy("number"))
    rows = materialize(both.applyInArrow(lambda a, b: _solved(a, b, k, percent), f"id {kind}, n long, z long, digest binary, items binary"), "jaccard-sets")
    discard(answers)
    return rows, total / max(1, lists)


def subsets(n: int, percent: int) -> int:
    """How many subsets a light set of n shingles enumerates."""
    return sum(math.comb(n, d) for d in range(n - need(n, percent) + 1))


def boundary(scan: float, percent: int) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning the lists of a set's rarest shingles."""
    for n in itertools.count(2):
        if subsets(n, percent) > max(1.0, (n - need(n, percent) + 1) * scan):
            return n - 1


def keys_of(items: np.ndarray, z: int, light: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes under which a set is listed, their places): subsets if it is light, rarest shingles if it may meet a heavy one.

    items: rarest first, the first z of them in no other set, so that they lead nowhere. The place of a
    shingle is the number of rarer ones: sets whose first common shingle has a late place have too few
    others to share. Subsets have place 0.
    """
    n = len(items)
    out, places = [], []
    if n <= light:
        for d in range(n - need(n, percent) + 1):
            for left in itertools.combinations(range(n), d):
                kept = np.sort(np.delete(items, left))
                with np.errstate(over="ignore"):
                    out.append(mix64(np.array([kept.sum() + np.uint64(len(kept))], np.uint64) ^ np.bitwise_xor.reduce(mix64(kept)))[0])
    if n >= need(light + 1, percent):
        places = range(z, n - need(n, percent) + 1)
    return np.concatenate([np.array(out, np.uint64), items[list(places)]]), np.array([0] * len(out) + list(places), np.int64)


def _listed(classes: DataFrame, light: int, percent: int, most: int | None = None) -> DataFrame:
    """(key, class, n, place, root): the lists; with most so many keys of a class only, those of least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(np.frombuffer(x, np.uint64), z, light, percent) for x, z in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            if most:
                picked = [np.argsort(mix64(k + np.uint64(1)), kind="stable")[:most] for k, _ in keys]
                keys = [(k[at], place[at]) for (k, place), at in zip(keys, picked)]
            counts = [len(x) for x, _ in keys]
            key, place = (np.concatenate([np.zeros(0, t), *(pair[c] for pair in keys)]) for c, t in ((0, np.uint64), (1, np.int64)))
            repeated = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts), pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *repeated, pa.array(place)], names=["key", "class", "n", "root", "place"])

    keys = classes.select("class", "n", "root", "z", "items").mapInArrow(tidy(run), "key long, class long, n long, root long, place long")
    return materialize(keys, "jaccard-keys")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a few sets: a product of 0-1 matrices, some columns at a time."""
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = count[which] > 1
    _, which = np.unique(which[shared], return_inverse=True)
    owner, out = owner[shared], np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(which.max(initial=-1)) + 1, COLUMNS):
        part = (which >= a) & (which < a + COLUMNS)
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[part], which[part] - a] = 1
        out += block @ block.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def linked(classes: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(class, least class that it hangs together with) by the links between sets; sets of equal root do already."""
    common, sizes = overlaps(sets), np.array([len(x) for x in sets])
    near = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) | (roots[:, None] == roots[None, :])
    least, before = classes, None
    while before is None or (least != before).any():
        before = least
        least = np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1)
    return [(a, b) for a, b in zip(classes.tolist(), least.tolist()) if a != b]


def _cells(live: DataFrame, percent: int) -> DataFrame:
    """(key, cell, class, n, root, most, probe): lists, cut by the sizes of sets.

    A set looks for sets of its size and smaller ones (probe), and lies at its own size for larger
    ones to find. most is the largest set that it can link to if the key is the first that both have in
    common, as a late place leaves few shingles to share; what can link to nothing is left out.
    """
    given = live.select("key", "class", "n", "root", F.floor((100 + percent) * (F.col("n") - F.col("place")) / percent - F.col("n")).alias("most"))
    cell = lambda x: F.floor(F.log(x.cast("double")) / math.log(STEP)).cast("int")
    least, up = F.ceil(F.col("n") * percent / 100), F.least("n", "most")
    own = F.when(F.col("most") >= F.col("n"), F.array(F.struct(cell(F.col("n")).alias("cell"), F.lit(False).alias("probe"))))
    looks = F.when(up >= least, F.transform(F.sequence(cell(least), cell(up)), lambda x: F.struct(x.alias("cell"), F.lit(True).alias("probe"))))
    none = F.slice(F.array(F.struct(F.lit(0).alias("cell"), F.lit(True).alias("probe"))), 1, 0)
    return given.select("key", "class", "n", "root", "most", F.explode(F.concat(F.coalesce(own, none), F.coalesce(looks, none))).alias("c")).select("key", "c.cell", "class", "n", "root", "most", "c.probe")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of classes with the root that their class has by now."""
    return rows.drop("root").join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node")


def _live(rows: DataFrame) -> DataFrame:
    """The rows of lists (or of their cells) in which different components may find each other."""
    cut = "probe" in rows.columns
    rows = rows if cut else rows.withColumn("cell", F.lit(0))
    both = (F.bool_or("probe") & ~F.bool_and("probe")) if cut else F.lit(True)
    found = rows.groupBy("key", "cell").agg(F.min("root").alias("a"), F.max("root").alias("b"), both.alias("both")).filter("a <> b AND both").select(F.col("key").alias("k"), F.col("cell").alias("c"))
    return materialize(rows.join(found, (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c"))).drop("k", "c"), "jaccard-live")


def _left(live: DataFrame) -> tuple[int, float]:
    """(members, pairs of different components) of lists or cells, counted and not made."""
    cut = "probe" in live.columns
    p, q = (F.sum(F.col("probe").cast("double")), F.sum((~F.col("probe")).cast("double"))) if cut else (F.count(F.lit(1)).cast("double"),) * 2
    parts = live.groupBy("key", "cell", "root").agg(p.alias("p"), q.alias("q")).groupBy("key", "cell").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * F.col("q")).alias("same"))
    members, pairs = parts.agg(F.sum(F.greatest("p", "q")), F.sum(F.col("p") * F.col("q") - F.col("same")) / (1 if cut else 2)).first()
    return members or 0, pairs or 0


def _gathered(classes: DataFrame, live: DataFrame, percent: int, seed: int) -> DataFrame:
    """(a, b): classes that hang together, found by gathering classes under the hubs of their cells, PART at a time with the hub itself.

    The hub of a cell is its member of least seeded hash, and a class goes to the least of its hubs,
    so near copies, which share most cells, come together, each set once. What is missed here is found
    in another round or by the pairs that are left.
    """
    order = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("hub"))
    hubs = live.groupBy("key", "cell").agg(F.min(order("class")).alias("o")).select(F.col("key").alias("k"), F.col("cell").alias("c"), "o")
    under = live.join(hubs, (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c"))).groupBy("class", "root").agg(F.min("o").alias("o")).select("class", "root", F.col("o.hub").alias("hub"))
    sizes = under.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).select(F.col("hub").alias("h"), "parts")
    dealt = under.join(sizes, F.col("hub") == F.col("h")).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "class"), "parts").cast("int"))
    # The hub goes to every part, so that parts of the same near copies hang together.
    copies = dealt.filter((F.col("class") == F.col("hub")) & (F.col("parts") > 1)).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter(F.col("to") != F.col("part")).withColumn("part", F.col("to"))
    every = dealt.select("hub", "part", "class", "root").unionByName(copies.select("hub", "part", "class", "root"))
    members = every.join(classes.select(F.col("class").alias("c"), "items"), F.col("class") == F.col("c")).select("hub", "part", "class", "root", "items")

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        pairs = linked(table.column("class").to_numpy(), sets, table.column("root").to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return members.groupBy("hub", "part").applyInArrow(run, "a long, b long")


def _verified(classes: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links among all pairs of a cell that are in different components and of sizes that can link."""
    lies = live.filter("NOT probe").select(F.col("key").alias("k"), F.col("cell").alias("c"), F.col("class").alias("b"), F.col("n").alias("m"), F.col("most").alias("o"), F.col("root").alias("r"))
    fits = (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c")) & (F.col("root") != F.col("r")) & (F.col("m") <= F.least("n", "most")) & (F.col("n") <= F.col("o")) & (100 * F.col("m") >= percent * F.col("n"))
    pairs = live.filter("probe").join(lies, fits).select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()
    sets = lambda c: classes.select(F.col("class").alias(f"{c}{c}"), F.col("items").alias(f"{c}s"))
    met = pairs.join(sets("a"), F.col("a") == F.col("aa")).join(sets("b"), F.col("b") == F.col("bb")).select("a", "b", F.col("as").alias("x"), F.col("bs").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append(100 * common >= percent * ((len(x) + len(y)) // 8 - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.mapInArrow(tidy(run), "a long, b long")


def links(classes: DataFrame, light: int, percent: int) -> DataFrame:
    """(node, root) of the classes that link to others, by (class, n, z, items).

    First a few keys of each class are gathered under hubs, which joins most near copies; their keys
    are then listed with one root and lead nowhere. What is left is gathered again, cut into cells,
    gathered as long as that helps, and verified pair by pair in the end.
    """
    found = materialize(_gathered(classes, _live(_listed(classes.withColumn("root", F.col("class")), light, percent, SOME)), percent, 1), "jaccard-links")
    roots, before = components(found), math.inf
    live = _live(_listed(_rooted(classes, roots), light, percent))
    for seed in itertools.count(2, 2):
        members, pairs = _left(live)
        if pairs > FEW * members and pairs <= before / 2:
            found = found.unionByName(materialize(_gathered(classes, live, percent, seed), "jaccard-links"))
            roots, before = components(found), pairs
            live = _live(_rooted(live, roots))
        elif "probe" not in live.columns:
            live, before = _live(_cells(live, percent)), math.inf
        else:
            break
    if pairs:
        roots = components(found.unionByName(materialize(_verified(classes, live, percent), "jaccard-links")))
    return roots


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, light: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id): one row per row of docs.

    Words are split at ASCII white space after lower-casing A-Z. Documents link if 100 * intersection
    >= percent * union of their sets of k-word shingles; a text of fewer words is one shingle; null and
    empty texts have no shingle and link to nothing. component_id is the smallest id that links lead
    to; null ids never win unless there are only such. Repeated ids are rows of their own. Further
    columns of any name don't matter. An empty table gives an empty result. Shingles are compared by
    64-bit hashes, sets of equal shingles by 128 bits of a digest of them. light: the largest light
    set, by default where the costs meet.
    """
    small_batches(docs.sparkSession)
    rows, scan = _sets(docs, id_col, text, k, percent)
    free_shuffles(docs.sparkSession)
    classes = rows.filter("items IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("z").alias("z"), F.first("items").alias("items"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "jaccard-classes")
    free_shuffles(docs.sparkSession)
    roots = links(classes, light or boundary(scan, percent), percent)
    named = classes.select("digest", "class", "least").join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    of = named.join(least, F.col("root") == F.col("r")).select(F.col("digest").alias("d"), "component_id")
    out = rows.select("id", "n", "digest").join(of, F.col("digest") == F.col("d"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all documents."""
    return jaccard_join(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the smallest id stays.

    Exactly one row of a group stays: of several rows with that id the first, and a row without id
    only if the group has no other. Texts without words link to nothing, so all of them stay.
    """
    row, given = "row number of the stage", docs if repeatable(docs) else materialize(docs, "jaccard-docs")
    numbered = given.withColumn(row, F.monotonically_increasing_id())
    found = jaccard_join(numbered, id_col=row, k=5, percent=80).select(F.col(row).alias("r"), F.col("component_id").alias("c"))
    ids = numbered.select(F.col(row).alias("n"), F.col("doc_id").alias("i"))
    best = found.join(ids, F.col("r") == F.col("n")).groupBy("c").agg(F.min(F.struct(F.col("i").isNull().alias("u"), "i", "r")).alias("s")).select(F.col("s.r").alias("kept row of the stage"))
    return numbered.join(best, F.col(row) == F.col("kept row of the stage"), "left_semi").drop(row)


#: Sets as lists of words joined by a space; links by joining on common shingles.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[p:p + 3], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.h, n.n FROM s JOIN r ON s.h = r.h JOIN n ON s.doc_id = n.doc_id),
c AS (SELECT doc_id FROM t GROUP BY doc_id, n HAVING 100 * count(*) >= 85 * n),
u AS (SELECT t.* FROM t JOIN c ON t.doc_id = c.doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON d.doc_id = m.a
"""
