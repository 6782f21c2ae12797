"""The driver tables read as metric reports, chunks, tags and assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import table


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with nation, region and month; the dimension tables are broadcast by their size."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    re = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        li.join(su, li.l_suppkey == su.s_suppkey)
        .join(na, su.s_nationkey == na.n_nationkey)
        .join(re, na.n_regionkey == re.r_regionkey)
        .select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    )


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report of quantity and record count by nation and month: file ``rpt-n`` holds the lines numbered n and is the n-th in time; ``rpt-4`` has no date."""
    per = sales(spark, sf_dir).groupBy("nation", "month", "l_linenumber").agg(F.sum("l_quantity").alias("qty"), F.count("*").cast("double").alias("n_records"))
    long = per.unpivot(["nation", "month", "l_linenumber"], ["qty", "n_records"], "metric", "value")
    return long.select(
        F.lit("sales").alias("family"), "metric", F.lit("nation").alias("grain"), F.col("nation").alias("entity"), "month", "value",
        F.concat(F.lit("rpt-"), F.col("l_linenumber")).alias("source_file"),
        F.when(F.col("l_linenumber") != 4, F.concat(F.lit("2002-0"), F.col("l_linenumber"))).alias("reported_in"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per line of a document that has text: id, source, ord, text, doc_id."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.filter("text is not null").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.filter(F.trim("text") != "").select(chunk_id(F.col("source"), F.col("ord")).alias("id"), "source", "ord", "text", "doc_id")


def chunk_id(source, ord_):
    """63-bit id: the first 8 bytes of sha256(source, NUL, ord), halved."""
    head = F.conv(F.substr(F.sha2(F.concat(source, F.lit("\0"), ord_.cast("string")), 256), F.lit(1), F.lit(16)), 16, 10)
    return F.floor(head.cast("decimal(20,0)") / 2).cast("bigint")


#: The same relations in DuckDB SQL.
SALES_SQL = """sales AS (
  SELECT n_name AS nation, r_name AS region, strftime(l_shipdate, '%Y-%m') AS month, l_linenumber, l_quantity, l_extendedprice, l_discount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
FACTS_SQL = SALES_SQL + """, facts AS (
  SELECT 'sales' AS family, metric, 'nation' AS grain, nation AS entity, month, value, 'rpt-' || l_linenumber AS source_file,
         CASE WHEN l_linenumber <> 4 THEN '2002-0' || l_linenumber END AS reported_in
  FROM (
    SELECT nation, month, l_linenumber, 'qty' AS metric, sum(l_quantity) AS value FROM sales GROUP BY ALL
    UNION ALL SELECT nation, month, l_linenumber, 'n_records', CAST(count(*) AS DOUBLE) FROM sales GROUP BY ALL
  )
)"""
LATEST_SQL = FACTS_SQL + """, latest AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY family, metric, grain, entity, month ORDER BY coalesce(reported_in, '') DESC, source_file DESC) AS k FROM facts
  ) WHERE k = 1
)"""
CHUNKS_SQL = """chunks AS (
  SELECT CAST(('0x' || substr(sha256(source || chr(0) || ord), 1, 16))::UBIGINT >> 1 AS BIGINT) AS id, source, ord, text, doc_id FROM (
    SELECT doc_id, source || '/' || doc_id AS source, unnest(range(0, len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text
    FROM documents WHERE text IS NOT NULL
  ) WHERE trim(text) <> ''
)"""
