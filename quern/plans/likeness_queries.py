"""Queries of joins at a difflib ratio, with SQL twins that split each pair at its longest match."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph, likeness
from quern.sources.tables import table


def _names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("label")).distinct()


def near_labels(spark, d):
    """Parts' names, alone, with their type, and their last words."""
    p = table(spark, d, "part")
    typed = p.select(F.concat_ws("-", "p_name", "p_type").alias("label"))
    return likeness.near_labels(_names(spark, d).unionByName(typed).unionByName(p.select(F.substring_index("p_name", " ", -1).alias("label"))).distinct())


def label_clusters(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("label")).distinct()
    return likeness.label_clusters(p, least=0.9)


def close_matches(spark, d):
    """Market segments and parts' names without some vowels against parts' names."""
    seg = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("word"))
    short = table(spark, d, "part").select(F.translate("p_name", "aeo", "").alias("word"))
    return likeness.close_matches(seg.unionByName(short).distinct(), _names(spark, d).select(F.col("label").alias("text"))).withColumn("ratio", F.round("ratio", 6))


def similar_variants(spark, d):
    """Items of four parts each, by their parts' names and sizes."""
    p = table(spark, d, "part").filter("p_partkey <= 240").select((F.col("p_partkey") % 60).alias("item"), F.concat_ws(" ", "p_name", F.col("p_size") % 9).alias("v"))
    return likeness.similar_variants(p.groupBy("item").agg(F.array_sort(F.collect_set("v")).alias("variants")))


def label_near_duplicates(spark, d):
    """Part types and brands as labels."""
    return graph.label_pairs(table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("label")).distinct(), 0.86)


def fuzzy_ratio_match(spark, d):
    """Part types for market segments, types and types without an E, by difflib ratio."""
    p, c = table(spark, d, "part").select("p_type"), table(spark, d, "customer")
    words = c.select(F.col("c_mktsegment").alias("entry")).unionByName(p.select(F.col("p_type").alias("entry"))).unionByName(p.select(F.translate("p_type", "E", "").alias("entry"))).distinct()
    return likeness.governed_match(words.select("entry", F.array("entry").alias("names")), p.distinct().select(F.col("p_type").alias("key"), F.array("p_type", F.concat("p_type", F.lit("S"))).alias("names")))


_FORM = "trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
NEAR_SQL = f"""WITH RECURSIVE l AS (SELECT p_name AS label FROM part UNION SELECT p_name || '-' || p_type FROM part UNION SELECT string_split(p_name, ' ')[-1] FROM part), f AS (SELECT label, {_FORM} AS form FROM l),
p AS (SELECT a.form AS x, b.form AS y, a.form AS tx, b.form AS ty FROM (SELECT DISTINCT form FROM f) a JOIN (SELECT DISTINCT form FROM f) b ON a.form < b.form AND least(length(a.form), length(b.form)) * 2 >= 0.86 * (length(a.form) + length(b.form)) - 1e-9),
{likeness.ratio_sql('p')},
w AS (SELECT x, y, 'alike' AS why FROM ratios WHERE ratio >= 0.86 UNION ALL SELECT a.form, b.form, 'contained' FROM f a JOIN f b ON length(a.form) < length(b.form) AND length(a.form) >= 4 AND contains(b.form, a.form)
  UNION ALL SELECT form, form, 'equal' FROM f)
SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, max(why) AS why FROM w JOIN f a ON a.form = w.x JOIN f b ON b.form = w.y WHERE a.label <> b.label GROUP BY 1, 2"""
CLUSTERS_SQL = f"""WITH RECURSIVE f AS (SELECT label, {_FORM} AS form FROM (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS label FROM pages WHERE url IS NOT NULL)),
p AS (SELECT a.form AS x, b.form AS y, a.form AS tx, b.form AS ty FROM f a JOIN f b ON a.form < b.form AND least(length(a.form), length(b.form)) * 2 >= 0.9 * (length(a.form) + length(b.form)) - 1e-9 WHERE a.form <> ''),
{likeness.ratio_sql('p')},
w AS (SELECT x, y FROM ratios WHERE ratio >= 0.9 UNION SELECT a.form, b.form FROM f a JOIN f b ON length(a.form) < length(b.form) AND length(a.form) >= 4 AND contains(b.form, a.form)),
e AS (SELECT a.label AS a, b.label AS b FROM w JOIN f a ON a.form = w.x JOIN f b ON b.form = w.y), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS label, a AS g FROM u UNION SELECT r.label, u.b FROM r JOIN u ON r.g = u.a), s AS (SELECT label, min(g) AS "group" FROM r GROUP BY label)
SELECT label, "group", count(*) OVER (PARTITION BY "group") AS size FROM s"""
CLOSE_SQL = f"""WITH RECURSIVE w AS (SELECT lower(c_mktsegment) AS word FROM customer UNION SELECT translate(p_name, 'aeo', '') FROM part),
k AS (SELECT DISTINCT p_name AS text FROM part), p AS (SELECT text AS x, word AS y, text AS tx, word AS ty FROM k, w WHERE word <> '' AND least(length(text), length(word)) * 2 >= 0.6 * (length(text) + length(word)) - 1e-9),
{likeness.ratio_sql('p')}, o AS (SELECT y AS word, x AS match, round(ratio, 6) AS ratio, CAST(row_number() OVER (PARTITION BY y ORDER BY ratio DESC, x DESC) AS INTEGER) AS rank FROM ratios WHERE ratio >= 0.6)
SELECT * FROM o WHERE rank <= 3"""
VARIANTS_SQL = f"""WITH RECURSIVE l AS (SELECT DISTINCT p_partkey % 60 AS item, p_name || ' ' || (p_size % 9) AS label FROM part WHERE p_partkey <= 240), f AS (SELECT DISTINCT item, {_FORM} AS form FROM l), g AS (SELECT DISTINCT form FROM f),
p AS (SELECT a.form AS x, b.form AS y, a.form AS tx, b.form AS ty FROM g a JOIN g b ON a.form < b.form AND least(length(a.form), length(b.form)) * 2 >= 0.85 * (length(a.form) + length(b.form)) - 1e-9),
{likeness.ratio_sql('p')}, w AS (SELECT x, y, ratio FROM ratios WHERE ratio >= 0.85 UNION ALL SELECT y, x, ratio FROM ratios WHERE ratio >= 0.85 UNION ALL SELECT form, form, 1.0 FROM g)
SELECT a.item AS a, b.item AS b, round(max(ratio), 4) AS ratio FROM w JOIN f a ON a.form = w.x JOIN f b ON b.form = w.y WHERE a.item < b.item GROUP BY 1, 2"""
PAIRS_SQL = f"""WITH RECURSIVE f AS (SELECT DISTINCT p_type || ' ' || p_brand AS label, lower(p_type || ' ' || p_brand) AS form FROM part),
p AS (SELECT a.label AS x, b.label AS y, a.form AS tx, b.form AS ty FROM f a JOIN f b ON a.label < b.label),
{likeness.ratio_sql('p')}
SELECT x AS a, y AS b FROM ratios WHERE ratio >= 0.86 UNION SELECT x, y FROM p WHERE least(length(tx), length(ty)) >= 4 AND (contains(tx, ty) OR contains(ty, tx))"""
FUZZY_SQL = f"""WITH RECURSIVE e AS (SELECT c_mktsegment AS entry FROM customer UNION SELECT p_type FROM part UNION SELECT translate(p_type, 'E', '') FROM part),
k AS (SELECT DISTINCT p_type AS key, p_type AS n FROM part UNION SELECT p_type, p_type || 'S' FROM part), p AS (SELECT entry AS x, n AS y, lower(entry) AS tx, lower(n) AS ty FROM e, k),
{likeness.ratio_sql('p')}, b AS (SELECT x, max((round(ratio, 4), key)) AS m FROM ratios JOIN k ON k.n = ratios.y WHERE ratio >= 0.8 GROUP BY x)
SELECT entry, m[2] AS governed, m[1] AS score, CASE WHEN m[1] >= 0.92 THEN 'yes' WHEN m IS NOT NULL THEN 'candidate' ELSE 'no' END AS state FROM e LEFT JOIN b ON e.entry = b.x"""

QUERIES = {f.__name__: f for f in (near_labels, label_clusters, close_matches, similar_variants, label_near_duplicates, fuzzy_ratio_match)}
ORACLES = {
    "near_labels": NEAR_SQL, "label_clusters": CLUSTERS_SQL, "close_matches": CLOSE_SQL, "similar_variants": VARIANTS_SQL, "label_near_duplicates": PAIRS_SQL, "fuzzy_ratio_match": FUZZY_SQL,
}
