"""Queries over names and raw line files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.operators import naming
from tipoff.plans.registry import register
from tipoff.sources import adapter as ad
from tipoff.sources.readers import clean_lines


def known(spark, sf):
    nations = ad.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("TeamID"), F.lit(0).alias("row"))
    return naming.lookup(nations)


def spelled(spark, sf):
    """Nation names in other spellings: blanks, case, underscores."""
    n = F.col("n_name")
    key = F.col("n_nationkey")
    return ad.table(spark, sf, "nation").select(F.when(key % 3 == 0, F.concat(F.lit(" "), F.lower(n))).when(key % 3 == 1, F.replace(n, F.lit(" "), F.lit("_"))).otherwise(F.concat(n, F.lit("x"))).alias("name"))


@register("name_exact", """WITH spelled AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN ' ' || lower(n_name) WHEN 1 THEN replace(n_name, ' ', '_') ELSE n_name || 'x' END AS name FROM nation)
 SELECT s.name, CAST(n.n_nationkey AS BIGINT) AS "TeamID", 'exact' AS how FROM (SELECT DISTINCT name FROM spelled) s JOIN nation n ON replace(lower(trim(s.name)), '_', ' ') = replace(lower(n.n_name), '_', ' ')""")
def name_exact(spark, sf):
    return naming.exact(spelled(spark, sf), known(spark, sf))


#: Bits of a number stand for the characters of one name; each character of the other moves
#: them by an addition (names here are short of 40 characters).
FUZZY_SQL = """WITH spelled AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN ' ' || lower(n_name) WHEN 1 THEN replace(n_name, ' ', '_') ELSE n_name || 'x' END AS name FROM nation),
 known AS (SELECT replace(lower(n_name), '_', ' ') AS clean, max(CAST(n_nationkey AS BIGINT)) AS "TeamID" FROM nation GROUP BY 1),
 wanted AS (SELECT name, trim(replace(lower(trim(name)), '_', ' ')) AS clean FROM spelled WHERE name <> 'nowhere'),
 same AS (SELECT name, "TeamID" FROM wanted JOIN known USING (clean)),
 pairs AS (SELECT w.name, k."TeamID", k.clean AS other, array_to_string(list_sort(string_split(w.clean, ' ')), ' ') AS a, array_to_string(list_sort(string_split(k.clean, ' ')), ' ') AS b FROM wanted w, known k WHERE w.name NOT IN (SELECT name FROM same)),
 masks AS (SELECT *, (CAST(1 AS BIGINT) << length(a)) - 1 AS bits, list_transform(range(1, length(b) + 1), lambda j: CAST(list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = b[j] THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT)) AS m FROM pairs),
 scored AS (SELECT *, 200.0::DOUBLE * (length(a) - bit_count(list_reduce(m, lambda v, x: ((v + (v & x)) | (v - (v & x))) & bits, bits))) / (length(a) + length(b)) AS score FROM masks),
 best AS (SELECT name, "TeamID", score, row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS place FROM scored)
 SELECT 'nowhere' AS name, CAST(99 AS BIGINT) AS "TeamID", 'override' AS how UNION ALL SELECT name, "TeamID", 'exact' FROM same UNION ALL SELECT name, "TeamID", 'fuzzy' FROM best WHERE place = 1 AND score >= 85"""


@register("name_fuzzy", FUZZY_SQL)
def name_fuzzy(spark, sf):
    overrides = spark.createDataFrame([("nowhere", 99)], "name string, TeamID long")
    return naming.resolve(spelled(spark, sf), overrides, known(spark, sf))



@register("vegas_clean", """SELECT CAST(2001 + l_orderkey % 7 AS INT) AS season, CAST(l_orderkey AS VARCHAR) AS date, 'T' || l_partkey AS home, 'T' || l_suppkey AS road, CAST(l_quantity AS DOUBLE) AS hscore, CAST(NULL AS DOUBLE) AS rscore,
 CAST(l_linenumber AS DOUBLE) AS line, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS neutral FROM lineitem WHERE l_linenumber <> 3""")
def vegas_clean(spark, sf):
    items = ad.table(spark, sf, "lineitem")
    quoted = lambda c: F.concat(F.lit(' "T'), F.col(c).cast("string"), F.lit('" '))
    raw = items.select(
        F.col("l_orderkey").cast("string").alias(" date"), quoted("l_partkey").alias('"home"'), quoted("l_suppkey").alias("road"), F.col("l_quantity").cast("string").alias("hscore"), F.lit("n/a").alias("rscore"),
        F.when(F.col("l_linenumber") == 3, "NL").otherwise(F.col("l_linenumber").cast("string")).alias("line "), F.when(F.col("l_partkey") % 2 == 0, "1").otherwise("").alias("neutral"), "l_orderkey",
    )
    return clean_lines(raw, F.lit(2001) + F.col("l_orderkey") % 7)
