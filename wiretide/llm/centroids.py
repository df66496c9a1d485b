"""Centroid clustering in exact integers, with annulus search.

By the triangle inequality a centroid nearer to a vector than some upper bound has a norm within that
bound of the vector's norm. Centroids are sorted by norm, a few of them give the bound, and a binary
search finds those inside the annulus; only they are compared, exactly, those on its rim included.
Each round reads the vectors once, sums by cluster in the tasks, and moves k sums to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, tidy

CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, "3"
#: Components below this size: the squared distance of 1,024 of them still fits a long.
LARGEST = 1 << 25
#: Vectors that a task compares at once.
BLOCK = 4096


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        norms = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        count = len(centroids)
        #: Places in the order that give the first bound, beside the nearest norm: about the square root of all.
        self.tried = np.unique(np.linspace(0, count - 1, math.isqrt(count)).astype(np.int64))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance, comparisons): the nearest one, of equals that of the smallest number."""
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        distance = lambda rows, place: ((vectors[rows] - self.centroids[self.order[place]]) ** 2).sum(axis=1)
        everything = np.arange(len(vectors))
        beside = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        bound = distance(everything, beside)
        for place in self.tried:
            np.minimum(bound, distance(everything, np.full(len(vectors), place)), out=bound)
        # Norms and roots are rounded by far less than this margin, so no centroid on the rim is missed.
        reach = np.sqrt(bound.astype(np.float64)) + 1e-6 * (1 + norms)
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        best, least = np.full(len(vectors), len(self.norms)), np.full(len(vectors), np.iinfo(np.int64).max)
        for place in range(low.min(), high.max()) if len(vectors) else ():
            rows = np.flatnonzero((low <= place) & (place < high))
            number, d = self.order[place], distance(rows, np.full(len(rows), place))
            better = (d < least[rows]) | ((d == least[rows]) & (number < best[rows]))
            best[rows[better]], least[rows[better]] = number, d[better]
        return best, least, int((high - low).sum())


def whole_numbers(vectors: DataFrame, id_col: str, vector: str, width: int, scale: int) -> DataFrame:
    """(id, units): floor(scale * component) of the vectors that have `width` components, all of them finite."""
    values = F.col(vector)
    usable = (F.size(values) == width) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    units = F.transform(values, lambda x: F.floor(x.cast("double") * scale))
    bound = F.exists(values, lambda x: F.abs(x.cast("double")) * scale >= LARGEST)
    checked = F.when(bound, F.raise_error(F.lit(f"a component is {LARGEST // scale} or more: squared distances would not fit a long"))).otherwise(units)
    return vectors.filter(usable).select(F.col(id_col).alias("id"), checked.cast("array<long>").alias("units"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _sums(units: DataFrame, centroids: list[list[int]]) -> dict[int, list[int]]:
    """For each cluster that has vectors: their number, then the sums of their components."""
    found = Annulus(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(found.centroids.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK))
                of, _, _ = found.nearest(x)
                order = np.argsort(of, kind="stable")
                first = np.searchsorted(of[order], present := np.unique(of))
                sums[present] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(of, minlength=len(counts))
        there = np.flatnonzero(counts)
        rows = np.column_stack([counts, sums])[there]
        parts = pa.ListArray.from_arrays(np.arange(len(there) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), parts], ["cluster", "parts"])

    # A task's sums fit a long for 2**38 vectors; over all tasks they are added as decimals.
    each = units.select("units").mapInArrow(tidy(run), "cluster int, parts array<long>").select("cluster", F.posexplode("parts").alias("place", "part"))
    total = each.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(28,0)")).alias("total")).collect()
    out: dict[int, dict[int, int]] = {}
    for row in total:
        out.setdefault(row.cluster, {})[row.place] = int(row.total)
    return {c: [x[k] for k in sorted(x)] for c, x in out.items()}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of each vector that can be clustered.

    Centroids start as the vectors whose sha256 of "seed:id" is smallest (of rows with one id, the
    smaller vector first; rows without an id come last). Each round gives every vector to its nearest
    centroid (of equals, the smaller number) and moves each centroid that has vectors to the floor of
    their mean; then vectors are given once more. All numbers are exact integers of the vector times
    `scale`, rounded down. Vectors that are null, of another width, or hold null or non-finite components
    are left out; a component of 32,768 or more (at the default scale) raises, as distances would not fit a long.
    Repeated rows count each; with fewer vectors than clusters there are fewer centroids; an empty table
    gives an empty result. Other columns don't matter. The driver holds clusters * width numbers.
    """
    spark = vectors.sparkSession
    units = materialize(whole_numbers(vectors, id_col, vector, width, scale), "cluster-units")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = units.select("units", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "units").limit(clusters).collect()
    now = [list(r.units) for r in first]
    for _ in range(rounds if now else 0):
        for number, (count, *sums) in _sums(units, now).items():
            now[number] = [s // count for s in sums]
    found = Annulus(now or [[0] * width])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                of, d, _ = found.nearest(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of, pa.int32()), pa.array(d)], ["id", "cluster", "distance"])

    kind = dict(units.dtypes)["id"]
    given = materialize(units.mapInArrow(tidy(give), f"id {kind}, cluster int, distance long"), "cluster-given")
    # At most `clusters` rows, so they can be broadcast.
    sums = {r.cluster: int(r.total) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(k, sums[k], sum(sums.values()), now[k]) for k in sorted(sums)]
    known = spark.createDataFrame(rows, "number int, cluster_inertia long, inertia long, centroid array<long>")
    out = given.join(F.broadcast(known), F.col("cluster") == F.col("number"))
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over all embeddings."""
    out = cluster(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def _sql() -> str:
    """Plain Lloyd rounds, one after the other."""
    near = """g{r} as materialized (
  select v.id, v.units, arg_min(c.number, d * {k} + c.number) as number, min(d) as distance
  from (select v.row_id, v.id, v.units, c.number, list_sum(list_transform(list_zip(v.units, c.units), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as d from v, c{r} c) v
  join c{r} c on c.number = v.number group by v.row_id, v.id, v.units)"""
    move = """c{n} as materialized (
  select c.number, coalesce(m.units, c.units) as units from c{r} c left join (
    select number, list((s - ((s % n) + n) % n) // n order by place) as units from (
      select number, place, sum(unit)::hugeint as s, count(*)::hugeint as n from (
        select number, generate_subscripts(units, 1) as place, unnest(units)::hugeint as unit from g{r}) group by number, place)
    group by number) m on m.number = c.number)"""
    steps = [
        f"""v as materialized (
  select row_number() over () as row_id, vec_id as id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as units
  from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {WIDTH})""",
        f"""c0 as materialized (
  select row_number() over (order by rank nulls last, units) - 1 as number, units from (
    select sha256('{SEED}:' || id::varchar) as rank, units from v order by rank nulls last, units limit {CLUSTERS}))""",
    ]
    for r in range(ROUNDS):
        steps += [near.format(r=r, k=CLUSTERS), move.format(r=r, n=r + 1)]
    steps.append(near.format(r=ROUNDS, k=CLUSTERS))
    end = f"""select g.id as vec_id, g.number::int as cluster, g.distance::bigint as distance, sum(g.distance) over (partition by g.number)::bigint as cluster_inertia,
  sum(g.distance) over ()::bigint as inertia, sha256(array_to_string(c.units, ',')) as centroid_sha256
from g{ROUNDS} g join c{ROUNDS} c on c.number = g.number"""
    return "with " + ",\n".join(steps) + "\n" + end


SQL = _sql()
