"""Metric marts on small literal tables."""

import pytest
from pyspark.sql import functions as F

from quern.operators import marts

FACT = "family string, metric string, grain string, entity string, month string, value double, source_file string, reported_in string"


def facts(spark, rows):
    return spark.createDataFrame([("f", m, "g", e, t, v, s, r) for m, e, t, v, s, r in rows], FACT)


def test_latest_report_wins_and_undated_is_oldest(spark):
    df = facts(spark, [("a", "x", "2026-01", 1.0, "z.xlsx", None), ("a", "x", "2026-01", 2.0, "b.xlsx", "2026-02"), ("a", "x", "2026-01", 3.0, "a.xlsx", "2026-02"), ("a", "y", "2026-01", 4.0, "q", None)])
    assert sorted((r["entity"], r["value"]) for r in marts.latest_wins(df).collect()) == [("x", 2.0), ("y", 4.0)]


def test_restated_or_conflict(spark):
    dated = [("a", "x", "2026-01", 1.0, "f1", "2026-01"), ("a", "x", "2026-01", 2.0, "f2", "2026-02")]
    undated = [("a", "y", "2026-01", 1.0, "f1", None), ("a", "y", "2026-01", 2.0, "f2", "2026-02"), ("a", "z", "2026-01", 5.0, "f1", "2026-01"), ("a", "z", "2026-01", 5.0 + 1e-12, "f2", "2026-02")]
    got = {r["entity"]: (r["value"], r["current_value"], r["kind"]) for r in marts.restatements(facts(spark, dated + undated)).collect()}
    assert got == {"x": (1.0, 2.0, "restated"), "y": (1.0, 2.0, "conflict")}


def collide(spark, rows, policies, weight="records"):
    flat = [("f", m, "g", e, "2026-01", v, "file", k) for k, (e, n, p) in enumerate(rows) for m, v in (("records", n), ("nps", p))]
    df = spark.createDataFrame(flat, "family string, metric string, grain string, entity string, month string, value double, source_file string, _row long")
    return {(r["entity"], r["metric"]): (r["value"], r["unresolved"]) for r in marts.resolve_collisions(df, policies, weight_metric=weight).collect()}


def test_collision_policies(spark):
    rows = [("harbour", 57.0, 31.5), ("mill", 12.0, 64.0), ("harbour", 3.0, 90.0)]
    got = collide(spark, rows, {"nps": "weighted_mean", "records": "sum"})
    assert got["harbour", "nps"][0] == pytest.approx((57 * 31.5 + 3 * 90) / 60) and got["harbour", "records"] == (60.0, False) and got["mill", "nps"] == (64.0, False)
    assert collide(spark, rows, {})["harbour", "nps"] == (90.0, False)
    assert collide(spark, rows, {"nps": "error"})["harbour", "nps"] == (90.0, True)
    nulls = [("mill", 8.0, 42.0), ("mill", 6.0, None), ("mill", None, -7.0)]
    assert collide(spark, nulls, {"nps": "weighted_mean"})["mill", "nps"] == (42.0, False)
    none = [("quay", 0.0, 33.0), ("quay", None, 9.0)]
    assert collide(spark, none, {"nps": "weighted_mean"})["quay", "nps"] == (9.0, True)
    with pytest.raises(ValueError):
        marts.resolve_collisions(spark.range(1), {"nps": "best"})


def test_rollup_ratio_and_coverage(spark):
    rows = [("q", "A", "2026-01", 10.0, "f", None), ("n", "A", "2026-01", 1.0, "f", None), ("q", "b", "2026-01", 20.0, "f", None), ("n", "b", "2026-01", 3.0, "f", None), ("q", "b", "2026-02", 5.0, "f", None)]
    df = facts(spark, rows)
    up = marts.weighted_rollup(df, spark.createDataFrame([("a", "P"), ("B", "P")], "entity string, parent string"), fine="g", coarse="top", rates=["q"], weight="n")
    assert sorted((r["metric"], r["month"], r["value"]) for r in up.collect()) == [("n", "2026-01", 4.0), ("q", "2026-01", 17.5)]
    assert [(r["entity"], r["value"]) for r in marts.derived_ratio(df, name="r", numerator="q", denominator="n").orderBy("entity").collect()] == [("A", 10.0), ("b", pytest.approx(20 / 3))]
    assert [(r["entity"], r["month"]) for r in marts.coverage_holes(df).collect()] == [("A", "2026-02")]
    got = marts.coverage_expected(df, start="2025-11", end="2026-02", entities=spark.createDataFrame([("A",), ("c",)], "entity string"))
    assert sorted((r["missing_kind"], r["name"]) for r in got.collect()) == [("entity", "c"), ("month", "2025-11"), ("month", "2025-12")]


def test_metric_filters_take_wildcards_as_they_are(spark):
    df = facts(spark, [("a", r"50%_\x", "2026-01", 1.0, "f", None), ("a", "50 ax", "2026-02", 2.0, "f", None)])
    assert marts.select_metric(df, "a", entity_contains="%_").count() == 1
    assert marts.select_metric(df, "a", start="2026-01", end="2026-01").count() == 1
    top = marts.first_rows(marts.select_metric(df, "a"), 1).collect()
    assert len(top) == 1 and top[0]["truncated"] and top[0]["month"] == "2026-01"
    with pytest.raises(ValueError):
        marts.first_rows(df, 0)


def test_notes_reach_computed_rows(spark):
    df = facts(spark, [("a", "x", "2026-01", 1.0, "f1", None), ("a", "x", "2026-02", 1.0, "f2", None)])
    notes = spark.createDataFrame([("f", "f1", None, "n1"), ("f", "f2", "2026-03", "n2")], "family string, source_file string, month string, text string")
    rows = df.select("family", "metric", "entity", "month", "source_file").unionByName(spark.createDataFrame([("f", "a", "all", "2026-01", "<rollup>")], "family string, metric string, entity string, month string, source_file string"))
    got = {(r["entity"], r["month"]): r["notes"] for r in marts.attach_notes(rows, notes, df).collect()}
    assert got == {("x", "2026-01"): "n1", ("x", "2026-02"): "", ("all", "2026-01"): "n1"}


def test_forward_fill_stops_at_labels(spark):
    df = spark.createDataFrame([(1, 1, "2026-01"), (1, 2, None), (1, 3, "Total"), (1, 4, None), (1, 5, "2026-02")], "row_id long, col long, label string")
    assert [r["month"] for r in marts.forward_fill(df).orderBy("col").collect()] == ["2026-01", "2026-01", None, None, "2026-02"]


def test_month_range(spark):
    assert spark.range(1).select(marts.month_range("2025-11", "2026-02").alias("m")).first()["m"] == ["2025-11", "2025-12", "2026-01", "2026-02"]
    assert marts.coverage_holes(facts(spark, [])).count() == 0 and marts.latest_wins(facts(spark, [])).filter(F.lit(True)).count() == 0
