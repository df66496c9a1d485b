"""Two JSON documents compared leaf by leaf: which paths differ, and how.

Documents are parsed as VARIANT values and opened level by level, so a document of any depth becomes
rows (path, kind, value) that Spark groups where the document's text already lies. Elements of an array are matched by their place, or by a key of
their own where one is named for that array, so that one element more doesn't shift all behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table

#: Objects nested deeper than this raise.
DEEPEST = 64
#: Characters of documents that one task compares: their leaves are some ten times that, and are sorted in memory.
SHARE = 8 << 20


def depth(json: Column) -> Column:
    """How many arrays and objects that aren't empty lie in each other at most, by the brackets of a JSON text."""
    bare = F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), '"[^"]*"', '""')
    brackets = F.regexp_replace(F.regexp_replace(bare, r"\{\s*\}|\[\s*\]", ""), r"[^\[\]{}]+", "")
    step = lambda now, x: F.when(x.isin("{", "["), F.struct((now["at"] + 1).alias("at"), F.greatest(now["most"], now["at"] + 1).alias("most"))).otherwise(F.struct((now["at"] - 1).alias("at"), now["most"].alias("most")))
    return F.when(brackets == "", 0).otherwise(F.aggregate(F.split(brackets, "(?<=.)(?=.)"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda now: now["most"]))


def leaves(documents: DataFrame, id_col: str, json: str, keys: dict[str, str] | None = None) -> DataFrame:
    """(id, path, kind, value) of every leaf of the JSON text of each row; empty arrays and objects are leaves.

    path: the fields from the top, joined by /; an element of an array is its place, or, if keys names a field
    for the array's path, [field=value] (its place where the element has no such field). In the paths of keys
    every array element is *. value: a leaf as JSON text. Null texts have no leaves, invalid ones raise.
    """
    return _leaves(documents.select(F.col(id_col).alias("id"), F.col(json).alias("json")), keys).select("id", "path", "kind", "value")


def _leaves(documents: DataFrame, keys: dict[str, str] | None = None, together: str | None = None) -> DataFrame:
    """The rows' further columns with path, kind and value of the leaves of json; together: a column whose equal
    values go to one task, texts and not leaves, so that what groups by it needs no exchange.

    The texts are written once, with their depth. All levels are opened in one pass; what is no container stays as it is.
    """
    spark = documents.sparkSession
    rows = cut(documents.filter("json is not null").withColumn("levels", depth(F.col("json"))), "documents")
    levels, size = rows.agg(F.coalesce(F.max("levels"), F.lit(0)), F.coalesce(F.sum(F.length("json")), F.lit(0))).first()
    if levels > DEEPEST:
        raise ValueError(f"a document is nested more than {DEEPEST} levels deep")
    rows = rows.repartition(size // SHARE + 1, together) if together else rows
    told = [c for c in rows.columns if c not in ("json", "levels")]
    now = rows.select(*told, F.lit("").alias("path"), F.lit("").alias("shape"), F.parse_json("json").alias("at"))
    for _ in range(levels):
        opened = now.lateralJoin(spark.tvf.variant_explode_outer(F.col("at").outer())).select(*told, "path", "shape", "at", "pos", "key", "value")
        place = F.col("pos").cast("string")
        for of, field in (keys or {}).items():
            own = F.try_variant_get("value", F.lit(f"$.{field}"), "string")
            place = F.when((F.col("shape") == of) & own.isNotNull(), F.concat(F.lit(f"[{field}="), own, F.lit("]"))).otherwise(place)
        step = F.coalesce("key", place)
        shape = F.coalesce("key", F.lit("*"))
        join = lambda a, b: F.when(F.col("pos").isNull(), F.col(a)).when(F.col(a) == "", b).otherwise(F.concat(F.col(a), F.lit("/"), b))
        now = opened.select(*told, join("path", step).alias("path"), join("shape", shape).alias("shape"), F.when(F.col("pos").isNull(), F.col("at")).otherwise(F.col("value")).alias("at"))
    return now.select(*told, "path", F.regexp_extract(F.schema_of_variant("at"), "^[A-Z]+", 0).alias("kind"), F.to_json("at").alias("value"))


def differences(left: DataFrame, right: DataFrame, id_col: str, json: str, keys: dict[str, str] | None = None, ignore: list[str] = ()) -> DataFrame:
    """(id, path, state, left, right): leaves that differ, or that one side hasn't; equal documents give no rows.

    state: changed, missing (right hasn't it) or added. ignore: patterns of paths that are not compared (as for
    RLIKE, from the beginning). Where a path occurs several times in one document, each value counts once.
    """
    texts = [x.select(F.col(id_col).alias("id"), F.lit(side).alias("side"), F.col(json).alias("json")) for x, side in ((left, "left"), (right, "right"))]
    rows = _leaves(texts[0].unionByName(texts[1]), keys, together="id")
    for pattern in ignore:
        rows = rows.filter(~F.col("path").rlike(f"^(?:{pattern})"))
    values = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("value"))).alias(side)
    # A null id equals no other.
    found = rows.groupBy("id", "path", F.when(F.col("id").isNull(), F.col("side")).alias("lone")).agg(values("left"), values("right"))
    text = lambda side: F.when(F.size(side) > 0, F.array_join(F.array_sort(side), " ")).alias(side)
    joined = found.select("id", "path", text("left"), text("right")).filter(~F.col("left").eqNullSafe(F.col("right")))
    state = F.when(F.col("left").isNull(), "added").when(F.col("right").isNull(), "missing").otherwise("changed")
    return joined.select(F.col("id").alias(id_col), "path", state.alias("state"), "left", "right")


def same_shape(left: DataFrame, right: DataFrame, id_col: str, json: str) -> DataFrame:
    """(id, path, state): fields, with arrays' elements as *, that only one of two documents has, or with another kind.

    Nulls and empty arrays fit any kind, as they say nothing of what else could stand there.
    """

    def fields(documents: DataFrame, side: str) -> DataFrame:
        rows = leaves(documents, id_col, json).withColumn("path", F.regexp_replace("path", r"(?<=^|/)\d+(?=/|$)", "*"))
        kind = F.when(F.col("kind") == "VOID", None).when(F.col("kind").isin("BIGINT", "DECIMAL", "DOUBLE", "INT"), "NUMBER").otherwise(F.col("kind"))
        return rows.groupBy("id", "path").agg(F.array_sort(F.collect_set(kind)).alias(side))

    joined = fields(left, "a").join(fields(right, "b"), ["id", "path"], "full")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").when((F.size("a") > 0) & (F.size("b") > 0) & (F.col("a") != F.col("b")), "kind")
    return joined.withColumn("state", state).filter("state is not null").select(F.col("id").alias(id_col), "path", "state")


# -- a query over the synthetic tables


def document_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON documents with their lines, beside a copy in which some leaves, lines and fields were changed."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"))
    whole = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "quantity")))
    numbered = F.transform("sorted", lambda x, k: F.struct((k + 1).alias("line"), x["part"].alias("part"), x["quantity"].alias("quantity")))
    lines = lines.groupBy("l_orderkey").agg(whole.alias("sorted")).select("l_orderkey", numbered.alias("lines"))
    orders = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kept = F.filter("lines", lambda x: (x["line"] % 3 != 1) | (F.col("o_orderkey") % 5 != 0))
    moved = F.transform(kept, lambda x: F.struct(x["line"].alias("line"), x["part"].alias("part"), F.when((x["line"] == 2) & (F.col("o_orderkey") % 4 == 0), x["quantity"] + 1).otherwise(x["quantity"]).alias("quantity")))
    head = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    other = F.struct(F.when(F.col("o_orderkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("customer"), F.when(F.col("o_orderkey") % 8 == 0, F.lit(True)).alias("checked"))
    left = orders.select("o_orderkey", F.to_json(F.struct(head.alias("head"), "lines")).alias("json"))
    right = orders.select("o_orderkey", F.to_json(F.struct(other.alias("head"), moved.alias("lines"))).alias("json"))
    return differences(left, right, "o_orderkey", "json", {"lines": "line"})


def contract_queries() -> dict:
    return {"document_differences": document_differences}


def contract_sql() -> dict[str, str]:
    return {
        "document_differences": """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INT)) AS n, l_partkey AS part, CAST(l_quantity AS INT) AS q, o_orderstatus AS s
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  o AS (SELECT DISTINCT k, s FROM l), gone AS (SELECT * FROM l WHERE n % 3 = 1 AND k % 5 = 0)
  SELECT k AS o_orderkey, 'head/status' AS path, 'changed' AS state, '"' || s || '"' AS left, '"X"' AS right FROM o WHERE k % 6 = 0 AND s <> 'X'
  UNION ALL SELECT k, 'head/checked', 'added', NULL, 'true' FROM o WHERE k % 8 = 0
  UNION ALL SELECT k, 'lines/[line=' || n || ']/' || f, 'missing', v, NULL FROM (
    SELECT k, n, unnest(['line', 'part', 'quantity']) AS f, unnest([CAST(n AS VARCHAR), CAST(part AS VARCHAR), CAST(q AS VARCHAR)]) AS v FROM gone)
  UNION ALL SELECT k, 'lines', 'added', NULL, '[]' FROM l GROUP BY k HAVING k % 5 = 0 AND bool_and(n % 3 = 1)
  UNION ALL SELECT k, 'lines/[line=2]/quantity', 'changed', CAST(q AS VARCHAR), CAST(q + 1 AS VARCHAR) FROM l WHERE n = 2 AND k % 4 = 0"""
    }
