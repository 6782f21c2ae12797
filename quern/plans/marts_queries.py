"""Queries of the metric marts, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import marts
from quern.plans.fixtures import FACTS_SQL, LATEST_SQL, SALES_SQL, raw_facts, sales
from quern.sources.tables import table


def _latest(spark, d):
    return marts.latest_wins(raw_facts(spark, d))


def _parents(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("parent"))


def _rollup(spark, d):
    return marts.weighted_rollup(_latest(spark, d), _parents(spark, d), fine="nation", coarse="region", rates=["qty"], weight="n_records")


def facts_latest_wins(spark, d):
    return _latest(spark, d).select("metric", "entity", "month", "value", "source_file", "reported_in")


def facts_restatements(spark, d):
    return marts.restatements(raw_facts(spark, d)).select("metric", "entity", "month", "value", "source_file", "current_value", "kind")


RESTATED_SQL = f"""WITH {FACTS_SQL}, r AS (
  SELECT *, round_even(value, 9) AS rv, row_number() OVER (PARTITION BY metric, entity, month ORDER BY coalesce(reported_in, '') DESC, source_file DESC) AS k FROM facts
), v AS (
  SELECT metric, entity, month, rv, min_by(source_file, coalesce(reported_in, ' ') || source_file) AS source_file,
         bool_or(reported_in IS NULL) AS undated, max(coalesce(reported_in, '')) AS last_at, min(k) AS k
  FROM r GROUP BY ALL
), w AS (
  SELECT *, count(*) OVER p AS n, max(CASE WHEN k = 1 THEN rv END) OVER p AS current_value, max(CASE WHEN k = 1 THEN last_at END) OVER p AS now_at,
         min(CASE WHEN k > 1 THEN CAST(NOT undated AND last_at < now_of AS INT) END) OVER p AS older
  FROM (SELECT *, max(CASE WHEN k = 1 THEN last_at END) OVER (PARTITION BY metric, entity, month) AS now_of FROM v) WINDOW p AS (PARTITION BY metric, entity, month)
)
SELECT metric, entity, month, rv AS value, source_file, current_value, CASE WHEN older = 1 THEN 'restated' ELSE 'conflict' END AS kind FROM w WHERE n > 1 AND k > 1"""


def _colliding(spark, d):
    """Orders by customer segment and day as one report a year: several rows under one key and file, weights in the same row."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(
        F.col("c_mktsegment").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("source_file"), F.col("o_orderkey").alias("_row"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 11 - 1).cast("double")).alias("records"),
    )
    long = rows.unpivot(["entity", "month", "source_file", "_row"], ["price", "records"], "metric", "value")
    return long.withColumns({"family": F.lit("orders"), "grain": F.lit("segment")})


COLLIDING_SQL = """o AS (
  SELECT c_mktsegment AS entity, strftime(o_orderdate, '%Y-%m') AS month, 'y' || year(o_orderdate) AS source_file, o_orderkey AS _row,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 11 - 1 AS DOUBLE) END AS records
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def facts_collisions_weighted_mean(spark, d):
    out = marts.resolve_collisions(_colliding(spark, d), {"price": "weighted_mean", "records": "sum"}, weight_metric="records")
    return out.select("metric", "entity", "month", "source_file", "policy", "n_rows", F.round("value", 6).alias("value"), "unresolved")


COLLISION_W_SQL = f"""WITH {COLLIDING_SQL}, g AS (
  SELECT entity, month, source_file, count(*) AS n_rows, sum(records) AS records, max_by(coalesce(price, -1), _row) AS last_price, max_by(coalesce(records, -99), _row) AS last_records,
         sum(CASE WHEN price IS NOT NULL AND records > 0 THEN price * records END) / sum(CASE WHEN price IS NOT NULL AND records > 0 THEN records END) AS wm
  FROM o GROUP BY ALL
)
SELECT 'price' AS metric, entity, month, source_file, 'weighted_mean' AS policy, n_rows, round(CASE WHEN n_rows > 1 THEN coalesce(wm, nullif(last_price, -1)) ELSE nullif(last_price, -1) END, 6) AS value, n_rows > 1 AND wm IS NULL AS unresolved FROM g
UNION ALL SELECT 'records', entity, month, source_file, 'sum', n_rows, CASE WHEN n_rows > 1 THEN coalesce(records, nullif(last_records, -99)) ELSE nullif(last_records, -99) END, false FROM g"""


def facts_collisions_policies(spark, d):
    rows = _colliding(spark, d).filter("metric = 'price' and value is not null").drop("metric")
    names = F.explode(F.array(*[F.lit(p) for p in ("last", "first", "max", "min", "sum", "mean", "error")]))
    rows = rows.withColumn("metric", names)
    out = marts.resolve_collisions(rows, {p: p for p in ("last", "first", "max", "min", "sum", "mean", "error")})
    return out.select("policy", "entity", "month", "n_rows", F.round("value", 8).alias("value"), "unresolved")


COLLISION_P_SQL = f"""WITH {COLLIDING_SQL}, g AS (
  SELECT entity, month, source_file, count(*) AS n_rows, max_by(price, _row) AS l, min_by(price, _row) AS f, max(price) AS mx, min(price) AS mn, sum(price) AS s, avg(price) AS m
  FROM o WHERE price IS NOT NULL GROUP BY ALL
)
SELECT p AS policy, entity, month, n_rows,
       round(CASE p WHEN 'first' THEN f WHEN 'max' THEN mx WHEN 'min' THEN mn WHEN 'sum' THEN s WHEN 'mean' THEN m ELSE l END, 8) AS value, p = 'error' AND n_rows > 1 AS unresolved
FROM g, (SELECT unnest(['last', 'first', 'max', 'min', 'sum', 'mean', 'error']) AS p)"""


def rollup_weighted(spark, d):
    return _rollup(spark, d).select("metric", "grain", "entity", "month", F.round("value", 6).alias("value"))


ROLLUP_SQL = LATEST_SQL + """, wide AS (
  SELECT entity, month, max(value) FILTER (WHERE metric = 'qty') AS q, coalesce(max(value) FILTER (WHERE metric = 'n_records'), 0) AS w FROM latest GROUP BY ALL
), up AS (
  SELECT r_name AS entity, month, sum(q * w) / nullif(sum(CASE WHEN q IS NOT NULL THEN w END), 0) AS q, sum(w) AS w
  FROM wide JOIN nation ON lower(entity) = lower(n_name) JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
)"""


def rollup_prefix(spark, d):
    facts = _latest(spark, d)
    parents = marts.prefix_parents(facts.select("entity"), [("i", "I-group"), ("c", "C-group"), ("in", "never"), ("", "rest")])
    return marts.weighted_rollup(facts, parents, fine="nation", coarse="group", rates=["qty"], weight="n_records").select("metric", "entity", "month", F.round("value", 6).alias("value"))


PREFIX_SQL = f"""WITH {LATEST_SQL}, wide AS (
  SELECT CASE WHEN lower(entity) LIKE 'i%' THEN 'I-group' WHEN lower(entity) LIKE 'c%' THEN 'C-group' ELSE 'rest' END AS g, month,
         max(value) FILTER (WHERE metric = 'qty') AS q, coalesce(max(value) FILTER (WHERE metric = 'n_records'), 0) AS w FROM latest GROUP BY entity, month
)
SELECT 'qty' AS metric, g AS entity, month, round(sum(q * w) / sum(w), 6) AS value FROM wide GROUP BY g, month HAVING sum(w) > 0
UNION ALL SELECT 'n_records', g, month, sum(w) FROM wide GROUP BY g, month"""


def derived_ratio(spark, d):
    return marts.derived_ratio(_latest(spark, d), name="qty_per_record", numerator="qty", denominator="n_records", scale=100.0).select("metric", "entity", "month", F.round("value", 6).alias("value"))


def coverage_holes(spark, d):
    return marts.coverage_holes(_latest(spark, d)).select("entity", "month")


def coverage_expected(spark, d):
    return marts.coverage_expected(_latest(spark, d), start="1994-11", end="2002-02", entities=table(spark, d, "nation").select(F.col("n_name").alias("entity")).unionByName(spark.createDataFrame([("ATLANTIS",)], "entity string")))


def metric_catalog(spark, d):
    catalog = spark.createDataFrame([("sales", "qty", "pieces"), ("sales", "n_records", "rows"), ("sales", "margin", "percent")], "family string, metric string, unit string")
    return marts.metric_catalog(_latest(spark, d), catalog)


def metric_rows(spark, d):
    facts = raw_facts(spark, d)
    rows = marts.select_metric(marts.latest_wins(facts), "qty", grain="nation", start="1997-03", end="1997-06")
    top = marts.first_rows(rows, 100)
    return marts.attach_versions(top, facts).select("entity", "month", "value", "source_file", "truncated", "n_versions", "version_state")


METRIC_ROWS_SQL = f"""WITH {LATEST_SQL}, s AS (
  SELECT *, row_number() OVER (ORDER BY month, grain, entity) AS k, count(*) OVER () > 100 AS truncated FROM latest WHERE metric = 'qty' AND month BETWEEN '1997-03' AND '1997-06'
), t AS (SELECT * FROM s WHERE k <= 100)
SELECT t.entity, t.month, t.value, t.source_file, t.truncated, count(f.value) FILTER (WHERE round_even(f.value, 9) <> round_even(t.value, 9)) AS n_versions,
       CASE WHEN count(f.value) FILTER (WHERE round_even(f.value, 9) <> round_even(t.value, 9)) > 0 THEN
         CASE WHEN bool_and(coalesce(f.reported_in < t.reported_in, false)) FILTER (WHERE round_even(f.value, 9) <> round_even(t.value, 9)) THEN 'restated' ELSE 'conflicting' END END AS version_state
FROM t JOIN facts f ON f.metric = t.metric AND f.entity = t.entity AND f.month = t.month GROUP BY ALL"""


def metric_range_contains(spark, d):
    return marts.select_metric(_latest(spark, d), "n_records", entity_contains="on_1", start="1996-01", end="1999-12").select("entity", "month", "value")


def metric_history(spark, d):
    facts = raw_facts(spark, d)
    return marts.metric_history(facts, _rollup(spark, d), "qty").select("grain", "entity", "month", F.round("value", 6).alias("value"), "source_file", "reported_in", "is_current")


HISTORY_SQL = f"""WITH {ROLLUP_SQL}
SELECT grain, entity, month, round(value, 6) AS value, source_file, reported_in,
       CAST(row_number() OVER (PARTITION BY entity, month ORDER BY coalesce(reported_in, '') DESC, source_file DESC) = 1 AS INT) AS is_current FROM facts WHERE metric = 'qty'
UNION ALL SELECT 'region', entity, month, round(q, 6), '<rollup>', NULL, 1 FROM up"""


def notes_inherit_rollup(spark, d):
    notes = spark.createDataFrame([("sales", "rpt-7", "1997-03", "late returns"), ("sales", "rpt-6", None, "draft"), ("sales", "rpt-1", "1999-01", "x")], "family string, source_file string, month string, text string")
    rows = _rollup(spark, d).select("family", "metric", "grain", "entity", "month", "source_file").unionByName(_latest(spark, d).select("family", "metric", "grain", "entity", "month", "source_file"))
    return marts.attach_notes(rows, notes, raw_facts(spark, d)).select("metric", "grain", "entity", "month", "source_file", "notes")


NOTES_SQL = f"""WITH {ROLLUP_SQL}, notes(source_file, month, text) AS (VALUES ('rpt-7', '1997-03', 'late returns'), ('rpt-6', NULL, 'draft'), ('rpt-1', '1999-01', 'x')),
rows AS (
  SELECT metric, grain, entity, month, source_file FROM latest
  UNION ALL SELECT 'qty', 'region', entity, month, '<rollup>' FROM up UNION ALL SELECT 'n_records', 'region', entity, month, '<rollup>' FROM up
), sup AS (SELECT DISTINCT month, source_file FROM facts),
reach AS (
  SELECT r.*, r.source_file AS f FROM rows r WHERE r.source_file <> '<rollup>'
  UNION ALL SELECT r.*, s.source_file FROM rows r LEFT JOIN sup s ON r.month = s.month WHERE r.source_file = '<rollup>'
)
SELECT r.metric, r.grain, r.entity, r.month, r.source_file, coalesce(string_agg(DISTINCT n.text, '|' ORDER BY n.text), '') AS notes
FROM reach r LEFT JOIN notes n ON n.source_file = r.f AND (n.month IS NULL OR n.month = r.month) GROUP BY ALL"""


def forward_fill_months(spark, d):
    """Parts as a banner row: a month label every so often, a stop label at times."""
    label = F.when(F.col("p_partkey") % 13 == 0, F.lit("Total")).when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("2026-"), F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0")))
    cells = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("row_id"), F.col("p_partkey").alias("col"), label.alias("label"))
    return marts.forward_fill(cells)


FILL_SQL = """WITH c AS (
  SELECT p_partkey % 40 AS row_id, p_partkey AS col, CASE WHEN p_partkey % 13 = 0 THEN 'Total' WHEN p_partkey % 5 = 0 THEN '2026-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') END AS label FROM part
), f AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY col) AS l FROM c)
SELECT row_id, col, label, CASE WHEN l <> 'Total' THEN l END AS month FROM f"""


def pricing_summary(spark, d):
    """The whole-table aggregation that every mart build begins with."""
    li = table(spark, d, "lineitem")
    return li.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n")
    )


def sales_by_region_month(spark, d):
    return sales(spark, d).groupBy("region", "month").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.sum("l_quantity").alias("qty"))


QUERIES = {
    f.__name__: f
    for f in (
        metric_rows, metric_range_contains, metric_catalog, metric_history, facts_latest_wins, facts_restatements, facts_collisions_weighted_mean, facts_collisions_policies,
        rollup_weighted, rollup_prefix, derived_ratio, coverage_holes, coverage_expected, notes_inherit_rollup, forward_fill_months, pricing_summary, sales_by_region_month,
    )
}

ORACLES = {
    "metric_rows": METRIC_ROWS_SQL,
    "metric_range_contains": f"WITH {LATEST_SQL} SELECT entity, month, value FROM latest WHERE metric = 'n_records' AND contains(lower(entity), 'on_1') AND month BETWEEN '1996-01' AND '1999-12'",
    "metric_catalog": f"""WITH {LATEST_SQL}, c(family, metric, unit) AS (VALUES ('sales', 'qty', 'pieces'), ('sales', 'n_records', 'rows'), ('sales', 'margin', 'percent'))
SELECT c.family, c.metric, c.unit, coalesce(string_agg(DISTINCT l.grain, ',' ORDER BY l.grain), '') AS grains, min(l.month) AS first_month, max(l.month) AS last_month, count(l.month) AS n_rows
FROM c LEFT JOIN latest l ON l.metric = c.metric GROUP BY ALL""",
    "metric_history": HISTORY_SQL,
    "facts_latest_wins": f"WITH {LATEST_SQL} SELECT metric, entity, month, value, source_file, reported_in FROM latest",
    "facts_restatements": RESTATED_SQL,
    "facts_collisions_weighted_mean": COLLISION_W_SQL,
    "facts_collisions_policies": COLLISION_P_SQL,
    "rollup_weighted": f"WITH {ROLLUP_SQL} SELECT 'qty' AS metric, 'region' AS grain, entity, month, round(q, 6) AS value FROM up WHERE q IS NOT NULL UNION ALL SELECT 'n_records', 'region', entity, month, w FROM up",
    "rollup_prefix": PREFIX_SQL,
    "derived_ratio": f"""WITH {LATEST_SQL} SELECT 'qty_per_record' AS metric, a.entity, a.month, round(a.value / b.value * 100, 6) AS value
FROM latest a JOIN latest b ON a.entity = b.entity AND a.month = b.month WHERE a.metric = 'qty' AND b.metric = 'n_records' AND b.value <> 0""",
    "coverage_holes": f"""WITH {LATEST_SQL} SELECT e.entity, m.month FROM (SELECT DISTINCT entity FROM latest) e, (SELECT DISTINCT month FROM latest) m
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.entity = e.entity AND l.month = m.month)""",
    "coverage_expected": f"""WITH {LATEST_SQL} SELECT 'month' AS missing_kind, strftime(m, '%Y-%m') AS name FROM (SELECT unnest(generate_series(DATE '1994-11-01', DATE '2002-02-01', INTERVAL 1 MONTH)) AS m)
WHERE strftime(m, '%Y-%m') NOT IN (SELECT month FROM latest)
UNION ALL SELECT 'entity', e FROM (SELECT n_name AS e FROM nation UNION SELECT 'ATLANTIS') WHERE e NOT IN (SELECT entity FROM latest)""",
    "notes_inherit_rollup": NOTES_SQL,
    "forward_fill_months": FILL_SQL,
    "pricing_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "sales_by_region_month": f"WITH {SALES_SQL} SELECT region, month, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, sum(l_quantity) AS qty FROM sales GROUP BY ALL",
}
