"""Queries of sheets, alike frames, groups of labels and hedged quotes over the driver tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import matching
from quern.plans.graph_queries import TAGS_SQL, _tags
from quern.sources import grids
from quern.sources.tables import table


def _cells(spark, d):
    """A sheet per brand: a title, a header, a row per part."""
    p = table(spark, d, "part")
    row = lambda n, *cells: p.select("p_brand").distinct().select(F.lit("parts").alias("file"), F.col("p_brand").alias("sheet"), F.lit(n).cast("long").alias("row"), F.array(*[F.lit(c) for c in cells]).alias("cells"))
    data = p.select(F.lit("parts").alias("file"), F.col("p_brand").alias("sheet"), (F.col("p_partkey") + 10).alias("row"), F.array(F.col("p_size").cast("string"), "p_type", F.concat(F.lit("$"), F.col("p_retailprice")), F.lit(None).cast("string")).alias("cells"))
    return row(1, "Report of parts").unionByName(row(2, "Size", " TYPE ", "Price", "Note")).unionByName(data)


def tolerant_facts(spark, d):
    facts = grids.tolerant_facts(_cells(spark, d), dims={"size": ["Size"], "type": ["Kind", "Type"]}, measures={"Price": "price"}, entity=r"([A-Z]+) ")
    return facts.groupBy("sheet", "grain", "metric", "entity").agg(F.count("*").alias("n"), F.max("value").alias("value"))


TOLERANT_SQL = """WITH g AS (SELECT p_brand AS sheet, count(DISTINCT p_size) >= count(DISTINCT p_type) AS by_size FROM part GROUP BY 1),
v AS (SELECT sheet, CASE WHEN by_size THEN 'size' ELSE 'type' END AS grain, CASE WHEN by_size THEN CAST(p_size AS VARCHAR) ELSE p_type END AS raw, p_retailprice AS value FROM part JOIN g ON sheet = p_brand)
SELECT sheet, grain, 'price' AS metric, CASE WHEN regexp_matches(raw, '^[A-Z]+ ') THEN regexp_extract(raw, '^([A-Z]+) ', 1) ELSE raw END AS entity, count(*) AS n, max(value) AS value FROM v GROUP BY ALL"""


def sheet_profiles(spark, d):
    x = grids.sheet_profiles(_cells(spark, d), samples=40)
    return x.select("file", "sheet", "n_rows", "n_cols", "header_row", F.array_join("columns", "|").alias("columns"), F.size("samples").alias("n_samples"), F.try_element_at("samples", F.lit(1)).alias("first_sample"))


PROFILES_SQL = """WITH s AS (SELECT p_brand AS sheet, count(*) + 2 AS n_rows, count(*) FILTER (WHERE p_partkey <= 32) AS n, min_by(p_size || ' | ' || p_type || ' | $' || p_retailprice || ' | ', p_partkey) FILTER (WHERE p_partkey <= 32) AS f FROM part GROUP BY 1)
SELECT 'parts' AS file, sheet, n_rows, 4 AS n_cols, 2 AS header_row, 'Size|TYPE|Price|Note' AS columns, CASE WHEN n > 0 THEN CAST(n AS INT) ELSE NULL END AS n_samples, f AS first_sample FROM s"""


def redundant_pairs(spark, d):
    return matching.redundant_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")))


REDUNDANT_SQL = """WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS ts FROM documents),
c AS (SELECT min(doc_id) AS id, count(*) AS n, ts FROM s WHERE len(ts) >= 15 GROUP BY ts),
p AS (SELECT x.id AS a, y.id AS b, x.n AS n_a, y.n AS n_b, len(x.ts) + len(y.ts) AS total, len(list_intersect(x.ts, y.ts)) AS i FROM c x JOIN c y ON x.id < y.id AND least(len(x.ts), len(y.ts)) >= 0.75 * greatest(len(x.ts), len(y.ts)))
SELECT a, b, n_a, n_b, round(i / (total - i), 3) AS score FROM p WHERE i >= 0.75 * (total - i)"""


def cluster_anchors(spark, d):
    n = table(spark, d, "nation")
    _, tags, _ = _tags(spark, d)
    return matching.cluster_anchors(n.select((F.col("n_nationkey") % 4).alias("group"), F.lower("n_name").alias("member"), F.col("n_nationkey").alias("pos")), tags)


ANCHORS_SQL = f"""WITH {TAGS_SQL}, m AS (SELECT n_nationkey % 4 AS grp, lower(n_name) AS member, n_nationkey AS pos, (SELECT count(DISTINCT chunk_id) FROM tags WHERE category_id = lower(n_name)) AS n_tags FROM nation),
a AS (SELECT *, first_value(member) OVER (PARTITION BY grp ORDER BY n_tags DESC, pos) AS anchor FROM m)
SELECT grp AS "group", member, n_tags, anchor, CASE WHEN member <> anchor THEN (SELECT count(*) FROM (SELECT chunk_id FROM tags WHERE category_id = member INTERSECT SELECT chunk_id FROM tags WHERE category_id = anchor)) END AS overlap FROM a"""


def modality_flags(spark, d):
    t = table(spark, d, "conversations")
    claims = t.filter("role = 'assistant'").select(F.col("conv_id").alias("claim"), "text").dropDuplicates(["claim"]).select("claim", F.when(F.col("claim") % 5 == 0, F.lit("According to him, it ships")).when(F.col("claim") % 5 == 1, F.lit("Does it ship? ")).otherwise("It ships").alias("text"))
    end = F.element_at(F.array(F.lit(" we might."), F.lit(" it might be so"), F.lit(" really?"), F.lit(" mightily")), (F.col("turn") % 4 + 1).cast("int"))
    return matching.modality_flags(claims, t.select(F.col("conv_id").alias("claim"), F.col("turn").alias("tag"), F.concat(F.lit("I say"), end).alias("quote")), hedges=["might", "might be"], keeps=["according to"])


MODALITY_SQL = """SELECT conv_id AS claim, turn AS tag, CASE turn % 4 WHEN 0 THEN 'might' WHEN 1 THEN 'might be' ELSE '?' END AS marker FROM conversations
WHERE turn % 4 <> 3 AND conv_id % 5 > 1 AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')"""


QUERIES = {f.__name__: f for f in (tolerant_facts, sheet_profiles, redundant_pairs, cluster_anchors, modality_flags)}
ORACLES = {"tolerant_facts": TOLERANT_SQL, "sheet_profiles": PROFILES_SQL, "redundant_pairs": REDUNDANT_SQL, "cluster_anchors": ANCHORS_SQL, "modality_flags": MODALITY_SQL}
