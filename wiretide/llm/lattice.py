"""Near duplicates among embeddings by lattice hashing.

A vector's direction is projected to two times eight random dimensions in each of several tables, and
each eight are decoded to the nearest point of the lattice E8. The two points name the vector's home
cell; it also visits the cells that lie nearest to it beside its home (one point moved by one of the 240
shortest lattice vectors). Vectors that meet in a cell which is the home of one of them are compared by
cosine. Equal vectors are one class from the start.

Links only lead to components first: cells give spanning edges, not all pairs. Then the links of each
vector are counted inside its component, exactly and in blocks, so that every link there counts,
whether a cell or a chain of others brought the two together. Cells and components above PART classes
are dealt to parts, and pairs of parts are compared; stretches that are known to be one component are
not compared again.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, mix64, partitions, read_table, small_batches, tidy
from .components import components

THRESHOLD = 0.93
#: Tables, visited cells beside the home, and how much a unit vector is stretched before it is decoded.
#: At the threshold a table misses almost half of all pairs, all twelve one in 5,000 (of 40,000; at 0.95 none).
TABLES, VISITS, STRETCH, SEED = 12, 8, 0.5, 20240531
BLOCKS, WIDTH = 2, 8
#: Classes of a cell or component that one task compares, and of a group whose pairs are listed one by one.
PART, FEW = 2048, 32


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that all are integers."""
    pairs = [[(a, s), (b, t)] for a, b in itertools.combinations(range(WIDTH), 2) for s in (-2, 2) for t in (-2, 2)]
    whole = np.zeros((len(pairs), WIDTH), np.int64)
    for row, places in zip(whole, pairs):
        for place, step in places:
            row[place] = step
    halves = np.array(list(itertools.product((-1, 1), repeat=WIDTH)), np.int64)
    return np.concatenate([whole, halves[halves.prod(axis=1) == 1]])


ROOTS = shortest()


def decode(points: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (doubled integers) to each row: the better one of the two cosets of D8."""

    def even(x: np.ndarray) -> np.ndarray:
        near = np.rint(x)
        off = x - near
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    whole, half = even(points), even(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], whole, half)).astype(np.int64)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component comes first to 1, so that no square is lost."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Projections for vectors of one dimension, alike on every machine."""

    def __init__(self, dimension: int, tables: int, visits: int, stretch: float):
        random = np.random.default_rng([SEED, dimension])
        self.visits = visits
        self.maps = random.standard_normal((tables, BLOCKS, dimension, WIDTH)) * stretch
        self.factors = random.integers(0, 1 << 63, (tables, BLOCKS, WIDTH), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def cells(self, units: np.ndarray, of: np.ndarray, table: int) -> np.ndarray:
        """Names of the home (first column) and of the visited cells of each vector, in one table."""
        gains, moves, home = [], [], np.full(len(units), table, np.uint64)
        with np.errstate(over="ignore"):
            for block in range(BLOCKS):
                points = units @ self.maps[table, block]
                near = decode(points)
                home += (near.astype(np.uint64) * self.factors[table, block]).sum(axis=1, dtype=np.uint64)
                gains.append((points - near / 2) @ ROOTS.T)
                moves.append((ROOTS.astype(np.uint64) * self.factors[table, block]).sum(axis=1, dtype=np.uint64))
            # A move by m changes the squared distance by |m|^2 - 2 gain, and all |m| are equal.
            best = np.argpartition(-np.concatenate(gains, axis=1), self.visits - 1, axis=1)[:, : self.visits]
            names = np.concatenate([home[:, None], home[:, None] + np.concatenate(moves)[best]], axis=1)
            return mix64(mix64(names) ^ of.astype(np.uint64)[:, None])


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each dimension in a list column."""
    lengths = np.asarray(column.value_lengths())
    flat, ends = np.asarray(column.flatten()), np.cumsum(lengths)
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield rows, flat[(ends[rows] - width)[:, None] + np.arange(width)]


def _places(classes: DataFrame, tables: int, visits: int, stretch: float) -> DataFrame:
    """(node, cell, home) of each class in each table; a home is named first of all in its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for batch in batches:
            node, of = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for rows, x in _by_width(batch.column(2)):
                if x.shape[1] not in known:
                    known[x.shape[1]] = Tables(x.shape[1], tables, visits, stretch)
                units = directions(x)
                for table in range(tables):
                    cells = known[x.shape[1]].cells(units, of[rows], table)
                    home = np.zeros(cells.shape, np.bool_)
                    home[:, 0] = True
                    columns = np.repeat(node[rows], cells.shape[1]), cells.ravel().view(np.int64), home.ravel(), np.full(cells.size, table == 0) & home.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "cell", "home", "first"])

    return classes.select("node", "of", "vector").mapInArrow(tidy(run), "node long, cell long, home boolean, first boolean")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, bounds of the groups): groups are rows alike in the first columns, never cut."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
        if held is None or not held.num_rows or batch is not None and held.num_rows < least:
            continue
        held = held.combine_chunks()
        new = np.zeros(held.num_rows, np.bool_)
        new[0] = True
        for k in range(keys):
            values = np.asarray(held.column(k))
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        # The last group may go on in the next batch.
        last = held.num_rows if batch is None else int(starts[-1])
        if last:
            inside = starts[starts < last]
            yield held.slice(0, last).combine_chunks(), np.append(inside, last)
        held = held.slice(last)


def _close(units: np.ndarray, bounds: np.ndarray, apart: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Links inside groups: ("pairs", i, j) of all small groups, and ("matrix", begin, links) of each larger one.

    In a group that is `apart`, only vectors of different sides are compared.
    """
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes[of] <= FEW
    for step in range(1, min(FEW, max(sizes, default=0))):
        i = np.flatnonzero(small[:-step] & (of[:-step] == of[step:]))
        i = i[~apart[of[i]] | (side[i] != side[i + step])]
        for at in range(0, len(i), 1 << 16):
            part = i[at : at + (1 << 16)]
            yield "pairs", (part := part[np.einsum("ij,ij->i", units[part], units[part + step]) >= threshold]), part + step
    for k in np.flatnonzero(sizes > FEW):
        x = units[bounds[k] : bounds[k + 1]]
        links = x @ x.T >= threshold
        np.fill_diagonal(links, False)
        if apart[k]:
            own = side[bounds[k] : bounds[k + 1]]
            links &= own[:, None] != own
        yield "matrix", int(bounds[k]), links


def spanning(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (first of its component, other) that connect what a symmetric matrix of links connects."""
    first = np.full(len(links), -1)
    for seed in range(len(links)):
        if first[seed] < 0:
            first[seed] = seed
            edge = links[seed] & (first < 0)
            while edge.any():
                first[edge] = seed
                edge = links[edge].any(axis=0) & (first < 0)
    other = np.flatnonzero(first != np.arange(len(links)))
    return first[other], other


def _compare(rows: DataFrame, threshold: float, count: bool) -> DataFrame:
    """rows (key, i, j, side, node, weight, vector): spanning edges (a, b) of each (key, i, j), or (node, links).

    links: the weights of the linked vectors, partial sums of one group each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_groups(batches, 3):
            i, j, side, node, weight = (np.asarray(table.column(k)) for k in range(1, 6))
            for members, x in _by_width(table.column(6).combine_chunks()):
                # A group has one dimension, so groups stay whole.
                inside = np.searchsorted(members, bounds)
                edges = np.unique(inside)
                begins = members[edges[:-1]]
                units, sums, ends = directions(x), np.zeros(len(members), np.int64), [[], []]
                own_side, own_weight = side[members], weight[members]
                for kind, *found in _close(units, edges, i[begins] != j[begins], own_side, threshold):
                    if kind == "pairs":
                        a, b = found
                        if count:
                            np.add.at(sums, a, own_weight[b])
                            np.add.at(sums, b, own_weight[a])
                    else:
                        begin, links = found
                        if count:
                            sums[begin : begin + len(links)] += links @ own_weight[begin : begin + len(links)]
                        else:
                            a, b = (e + begin for e in spanning(links))
                    if not count:
                        ends[0].append(node[members[a]])
                        ends[1].append(node[members[b]])
                if count:
                    some = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(node[members[some]]), pa.array(sums[some])], ["node", "links"])
                elif ends[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)) for e in ends], ["a", "b"])

    dealt = rows.select("key", "i", "j", "side", "node", "weight", "vector").repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(tidy(run), "node long, links long" if count else "a long, b long")


def _parts(rows: DataFrame, part: int, known: bool) -> DataFrame:
    """rows (key, within, node, ...) of large keys, once for each pair of parts (i, j) that has to be compared.

    What is alike in `within` gets parts of its own where it is large; the rest of a key is dealt by a hash
    of within. known: two parts with the same `within` are not compared.
    """
    sizes = rows.groupBy("key", "within").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") >= max(2, part // 2)
    rest = sizes.groupBy("key").agg(F.sum(F.when(~large, F.col("n"))).alias("rest"))
    sizes = sizes.join(rest, "key")
    split = lambda of, by, n: F.pmod(F.xxhash64(by, F.lit(7)), F.greatest(F.ceil(of / n), F.lit(1))).cast("long")
    sizes = sizes.select(F.col("key").alias("k"), F.col("within").alias("w"), large.alias("own"), "n", split(F.coalesce("rest", F.lit(0)), F.col("within"), max(1, part // 2)).alias("mixed"))
    name = F.when(F.col("own"), F.concat(F.col("within").cast("string"), F.lit("/"), split(F.col("n"), F.col("node"), part).cast("string"))).otherwise(F.concat(F.lit("+"), F.col("mixed").cast("string")))
    placed = rows.join(sizes, (F.col("key") == F.col("k")) & (F.col("within") == F.col("w"))).withColumn("part", F.xxhash64(name)).withColumn("pure", F.when(F.col("own"), F.col("within")))
    placed = materialize(placed.select(*rows.columns, "part", "pure"), "lattice-parts")
    names = placed.groupBy("key", "part").agg(F.first("pure").alias("pure"))
    a, b = (names.select(F.col("key").alias(f"k{x}"), F.col("part").alias(x), F.col("pure").alias(f"p{x}")) for x in "ij")
    pairs = a.join(b, (F.col("ki") == F.col("kj")) & (F.col("i") <= F.col("j")))
    if known:
        pairs = pairs.filter("pi is null or pj is null or pi <> pj")
    pairs = pairs.select(F.col("ki").alias("k"), "i", "j")
    both = lambda end, side: placed.join(pairs, (F.col("key") == F.col("k")) & (F.col("part") == F.col(end))).withColumn("side", F.lit(side))
    return both("i", 0).unionByName(both("j", 1).filter("i < j"))


def usable(vector: str, label: str) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite, with a label."""
    v = F.col(vector)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & ~broken & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, visits: int = VISITS, stretch: float = STRETCH, part: int = PART) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of vectors.

    Two vectors link if their labels are equal and not null, they have as many components, and their cosine in
    double precision is the threshold or more. n_links: other rows linked directly, equal vectors
    included; component_id: smallest id reachable by links; kept: the id is the component_id. Vectors
    that are null, empty or zero, or hold null or non-finite components, and those without label, link with nothing. Rows
    without id count as links and are kept only where no row of their component has an id; rows
    that repeat the smallest id are ties and are all kept. An empty table gives an empty result. Other
    columns don't matter. A pair that no chain of links joins in any table is missed (one in 5,000 of lone
    pairs at the threshold itself); none below the threshold is linked.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    values = F.col(vector)
    ok = usable(vector, label)
    name = F.col(label).cast("string")
    hashed = lambda seed: F.when(ok, F.xxhash64(F.lit(seed), values, name))
    rows = vectors.select(F.col(id_col).alias("id"), hashed(1).alias("h1"), hashed(2).alias("h2"), F.when(ok, F.xxhash64(name, F.size(values))).alias("of"), F.when(ok, values).alias("vector"))
    classes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"), F.first("of").alias("of"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "lattice-classes")
    places = materialize(_places(classes, tables, visits, stretch), "lattice-places")

    # Cells where nobody is at home, or where somebody is alone, compare nothing.
    cells = places.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("lived")).filter("n > 1 and lived").select(F.col("cell").alias("c"), "n")
    vectors_of = classes.select(F.col("node").alias("v"), "weight", "vector")
    met = places.join(cells, F.col("cell") == F.col("c")).select("node", F.col("cell").alias("key"), "n")
    dealt = met.withColumn("i", F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("n") / part)).cast("long"))
    near = dealt.join(vectors_of, F.col("node") == F.col("v")).select("key", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "node", "weight", "vector")
    edges = materialize(_compare(near, threshold, False), "lattice-edges")
    found = materialize(components(edges), "lattice-components")

    # Parts of crowded cells: what is in one component already needs no comparison.
    crowded = met.filter(F.col("n") > part)
    if not crowded.isEmpty():
        owners = found.select(F.col("node").alias("o"), "root")
        crowd = crowded.join(owners, F.col("node") == F.col("o"), "left").select("key", F.coalesce("root", "node").alias("within"), "node")
        several = crowd.groupBy("key").agg(F.min("within").alias("lo"), F.max("within").alias("hi")).filter("lo <> hi").select(F.col("key").alias("k"))
        crowd = crowd.join(several, F.col("key") == F.col("k"), "left_semi")
        pieces = _parts(crowd, part, True).join(vectors_of, F.col("node") == F.col("v"))
        more = _compare(pieces, threshold, False)
        found = materialize(components(edges.unionByName(more)), "lattice-components")

    # Links are counted inside components.
    homes = places.filter("first").select(F.col("node").alias("h"), F.col("cell").alias("within"))
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select(F.col("root").alias("r"), "n")
    member = found.join(sizes, F.col("root") == F.col("r")).select("node", F.col("root").alias("key"), "n")
    whole = member.filter(F.col("n") <= part).select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "node")
    large = member.filter(F.col("n") > part)
    if not large.isEmpty():
        spread = large.join(homes, F.col("node") == F.col("h")).select("key", "within", "node")
        whole = whole.unionByName(_parts(spread, part, False).select("key", "i", "j", "side", "node"))
    counted = _compare(whole.join(vectors_of, F.col("node") == F.col("v")), threshold, True)
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))

    least = found.join(classes.select(F.col("node").alias("v"), "least"), F.col("node") == F.col("v")).groupBy("root").agg(F.min("least").alias("lowest")).select(F.col("root").alias("r"), "lowest")
    known = classes.select("h1", "h2", "node", "weight", "least")
    known = known.join(found.select(F.col("node").alias("v"), "root"), F.col("node") == F.col("v"), "left").join(least, F.col("root") == F.col("r"), "left").drop("v")
    known = known.join(links.select(F.col("node").alias("v"), "links"), F.col("node") == F.col("v"), "left")
    known = materialize(known.select("h1", "h2", F.coalesce("lowest", "least").alias("lowest"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n")), "lattice-known")
    free_shuffles(spark)
    out = rows.select("id", "h1", "h2").join(known.withColumnsRenamed({"h1": "k1", "h2": "k2"}), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("lowest"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over all embeddings."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


SQL = f"""
with recursive v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
reached(vec_id, other) as (select vec_id, vec_id from v union select r.vec_id, l.b from reached r join links l on l.a = r.other)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.least, e.vec_id) as component_id, coalesce(c.least, e.vec_id) = e.vec_id as kept
from embeddings e
left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
left join (select vec_id, min(other) as least from reached group by vec_id) c on c.vec_id = e.vec_id
"""
