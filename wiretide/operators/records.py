"""Records with front matter, comparisons of name lists, and the three surfaces of a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .textscan import IDENTITY_RULES, AllowList, scan_identity
from ..functions.text import matches_any

#: Fixed value: the line before and after a record's fields.
FENCE = "---"


def front_matter(files: DataFrame) -> DataFrame:
    """(path, fields, body, problem) of (path, content): `key: value` lines between two fences, then a body.

    Blank lines and those that begin with # are left out; of a repeated key the last value holds.
    problem says why a record has no fields: no first fence, no second one, or a line without a colon.
    """
    rows = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n", -1)
    numbered = files.select("path", rows.alias("rows")).withColumn("end", F.array_position(F.transform(F.slice("rows", 2, 2_000_000_000), lambda x: F.trim(x)), FENCE))
    inner = F.filter(F.transform(F.slice("rows", 2, F.greatest(F.col("end") - 1, F.lit(0)).cast("int")), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    problem = F.when(F.trim(F.element_at("rows", 1)) != FENCE, "no first fence").when(F.col("end") == 0, "no second fence").when(F.exists("inner", lambda x: ~x.contains(":")), "a line without a colon")
    told = numbered.withColumn("inner", inner).withColumn("problem", problem)
    pairs = F.transform("inner", lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    fields = F.when(F.col("problem").isNull(), F.map_from_entries(_last(pairs)))
    body = F.when(F.col("problem").isNull(), F.array_join(F.slice("rows", (F.col("end") + 2).cast("int"), 2_000_000_000), "\n"))
    return told.select("path", fields.alias("fields"), body.alias("body"), "problem")


def _last(pairs: Column) -> Column:
    """The pairs without those whose key comes again."""
    return F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, 2_000_000_000), lambda y: y["key"] == x["key"]))


def differences(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """(name, side): what only one of two lists has; repeated names count once, null is a name."""
    left, right = left.select(F.col(name)).distinct(), right.select(F.col(name)).distinct()
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def tokens(text: Column) -> Column:
    """Letters and digits between everything else, lower-case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda x: x != ""))


def stopped(names: DataFrame, stop: list[str], name: str = "name") -> DataFrame:
    """(name, words) of the names that have a word of the stop list."""
    found = names.select(F.col(name), F.array_sort(F.array_intersect(tokens(F.col(name)), F.array(*map(F.lit, stop)))).alias("words"))
    return found.filter(F.size("words") > 0)


def first_revisions(trees: DataFrame) -> DataFrame:
    """(path, revision): each name of any revision with the one that is listed first, of (path, revision, pos)."""
    return trees.groupBy("path").agg(F.min_by("revision", "pos").alias("revision"))


def history(trees: DataFrame, messages: DataFrame, allow: AllowList | None = None, literals: list[str] = ()) -> DataFrame:
    """(surface, revision, path, line, rule_id): identity rules over a repository's history.

    trees: (revision, pos, path, line, text), all lines of all revisions; messages: (revision, text).
    Every line counts in each of its revisions, a message's rule once, and a file name once, in its
    first revision. Declared values hold on all surfaces, exceptions by path where there is a path. A
    text that stands in several revisions is looked at once.
    """
    allow = allow or AllowList()

    def rules(texts: DataFrame) -> DataFrame:
        found = scan_identity(texts.select(F.col("text").alias("path"), F.lit(1).alias("line"), "text").distinct(), allow.values, literals)
        return found.select(F.col("path").alias("found"), "rule_id").distinct()

    def permitted(hits: DataFrame) -> DataFrame:
        for rule in IDENTITY_RULES:
            if patterns := allow.for_rule(rule):
                hits = hits.filter(~((F.col("rule_id") == rule) & matches_any(F.col("path"), patterns)))
        return hits

    place = lambda df, surface, path, line: df.select(F.lit(surface).alias("surface"), "revision", path.alias("path"), line.cast("int").alias("line"), "rule_id")
    none = F.lit(None).cast("string")
    contents = trees.join(rules(trees), F.col("text") == F.col("found"))
    names = first_revisions(trees).withColumn("text", F.col("path"))
    named = names.join(rules(names), F.col("text") == F.col("found"))
    said = messages.join(rules(messages), F.col("text") == F.col("found")).select("revision", "rule_id").distinct()
    out = place(permitted(contents), "tree", F.col("path"), F.col("line"))
    return out.unionByName(place(said, "message", none, none)).unionByName(place(permitted(named), "name", F.col("path"), none))


# -- queries over the synthetic tables


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of suppliers, some of them malformed, as keys and values."""
    k = F.col("s_suppkey")
    head = F.when(k % 7 == 0, "--").otherwise("---")
    text = F.concat_ws("\n", head, F.concat(F.lit("name: "), "s_name"), F.lit("# a note"), F.lit(""), F.concat(F.lit("balance : "), F.when(k % 2 == 0, "low").otherwise("high:er")), F.when(k % 5 == 0, "no colon").otherwise("name: again"), F.when(k % 11 == 0, "...").otherwise(" --- "), F.concat(F.lit("body of "), "s_name"), F.lit("---"))
    out = front_matter(table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), text.alias("content")))
    return out.select(F.col("path").cast("long").alias("supplier"), F.col("fields")["name"].alias("name"), F.col("fields")["balance"].alias("balance"), F.coalesce(F.size("fields"), F.lit(0)).cast("long").alias("n_fields"), "body", "problem")


def catalogue_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels, and labels without documents once the oldest ones are gone."""
    docs = table(spark, sf_dir, "documents").filter("doc_id >= 20").select(F.col("doc_id").alias("name"))
    return differences(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name")))


def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that have one of three words."""
    rows = stopped(table(spark, sf_dir, "part").select(F.concat_ws("-", "p_name", "p_type").alias("name")), ["brass", "steel", "promo"])
    return rows.select("name", F.array_join("words", ",").alias("words")).groupBy("name", "words").agg(F.count(F.lit(1)).alias("parts"))


def history_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history made of orders: a revision a day of the month, files by customer, messages by priority."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.dayofmonth("o_orderdate"))
    path = F.concat(F.when(F.col("o_custkey") % 13 == 0, "plc-").otherwise("src/f"), (F.col("o_custkey") % 40).cast("string"))
    text = F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("host 192.168.3."), (F.col("o_orderkey") % 9).cast("string"))).otherwise("plain")
    trees = o.select(F.concat(F.lit("r"), "day").alias("revision"), F.col("day").alias("pos"), path.alias("path"), (F.col("o_orderkey") % 50).cast("int").alias("line"), text.alias("text"))
    messages = o.select(F.concat(F.lit("r"), "day").alias("revision"), F.concat(F.lit("see 10.0.0."), "day", F.lit(" and HMI_"), (F.col("o_custkey") % 3).cast("string")).alias("text"))
    allow = AllowList("identity-value:10.0.0.7\nidentity-path:identity-private-ipv4:src/f5\n")
    return history(trees, messages, allow).groupBy("surface", "revision", "path", "rule_id").agg(F.count(F.lit(1)).alias("hits"))


def contract_queries() -> dict:
    return {f.__name__: f for f in (record_fields, catalogue_differences, stop_words, history_hits)}


def contract_sql() -> dict[str, str]:
    return {
        "record_fields": """WITH t AS (SELECT s_suppkey AS supplier, [CASE WHEN s_suppkey % 7 = 0 THEN '--' ELSE '---' END, 'name: ' || s_name, '# a note', '', 'balance : ' || CASE WHEN s_suppkey % 2 = 0 THEN 'low' ELSE 'high:er' END,
    CASE WHEN s_suppkey % 5 = 0 THEN 'no colon' ELSE 'name: again' END, CASE WHEN s_suppkey % 11 = 0 THEN '...' ELSE ' --- ' END, 'body of ' || s_name, '---'] AS l FROM supplier),
  e AS (SELECT supplier, l, list_position(list_transform(l[2:], lambda x: trim(x)), '---') AS stop FROM t),
  i AS (SELECT *, list_filter(list_transform(l[2:stop], lambda x: trim(x)), lambda x: x <> '' AND x NOT LIKE '#%') AS inner_lines FROM e),
  p AS (SELECT *, CASE WHEN trim(l[1]) <> '---' THEN 'no first fence' WHEN stop IS NULL THEN 'no second fence' WHEN len(list_filter(inner_lines, lambda x: NOT contains(x, ':'))) > 0 THEN 'a line without a colon' END AS problem FROM i),
  v AS (SELECT *, list_last(list_filter(inner_lines, lambda x: trim(split_part(x, ':', 1)) = 'name')) AS n, list_last(list_filter(inner_lines, lambda x: trim(split_part(x, ':', 1)) = 'balance')) AS b FROM p)
  SELECT supplier, CASE WHEN problem IS NULL THEN trim(regexp_replace(n, '^[^:]*:', '')) END AS name, CASE WHEN problem IS NULL THEN trim(regexp_replace(b, '^[^:]*:', '')) END AS balance,
    CASE WHEN problem IS NULL THEN CAST(len(list_distinct(list_transform(inner_lines, lambda x: trim(split_part(x, ':', 1))))) AS BIGINT) ELSE 0 END AS n_fields, CASE WHEN problem IS NULL THEN array_to_string(l[stop + 2:], chr(10)) END AS body, problem FROM v""",
        "catalogue_differences": """(SELECT doc_id AS name, 'left' AS side FROM documents WHERE doc_id >= 20 AND doc_id NOT IN (SELECT doc_id FROM labels))
  UNION (SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id >= 20))""",
        "stop_words": """WITH t AS (SELECT p_name || '-' || p_type AS name FROM part), w AS (SELECT name, list_sort(list_intersect(regexp_split_to_array(lower(name), '[^a-z0-9]+'), ['brass', 'steel', 'promo'])) AS words FROM t)
  SELECT name, array_to_string(words, ',') AS words, count(*) AS parts FROM w WHERE len(words) > 0 GROUP BY ALL""",
        "history_hits": r"""WITH o AS (SELECT 'r' || day(o_orderdate) AS revision, day(o_orderdate) AS pos, CASE WHEN o_custkey % 13 = 0 THEN 'plc-' ELSE 'src/f' END || (o_custkey % 40) AS path,
    CASE WHEN o_orderkey % 6 = 0 THEN 'host 192.168.3.' || (o_orderkey % 9) ELSE 'plain' END AS text, 'see 10.0.0.' || day(o_orderdate) || ' and hmi_' || (o_custkey % 3) AS message FROM orders),
  n AS (SELECT path, arg_min(revision, pos) AS revision FROM o GROUP BY path)
  SELECT 'tree' AS surface, revision, path, 'identity-private-ipv4' AS rule_id, count(*) AS hits FROM o WHERE regexp_matches(text, '(^|[^\d.])192\.168\.\d{1,3}\.\d{1,3}($|[^\d])') AND path <> 'src/f5' GROUP BY ALL
  UNION ALL SELECT DISTINCT 'message', revision, NULL, 'identity-private-ipv4', 1 FROM o WHERE regexp_matches(message, '(^|[^\d.])10\.\d{1,3}\.\d{1,3}\.\d{1,3}($|[^\d])') AND NOT regexp_matches(message, '10\.0\.0\.7($|[^\d])')
  UNION ALL SELECT DISTINCT 'message', revision, NULL, 'identity-device-name', 1 FROM o WHERE regexp_matches(message, '\bhmi[-_]\d{1,4}\b')
  UNION ALL SELECT 'name', revision, path, 'identity-device-name', 1 FROM n WHERE regexp_matches(path, '\bplc[-_]\d{1,4}\b')""",
    }
