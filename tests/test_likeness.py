"""Joins at a difflib ratio against all pairs."""

import difflib
import random

import duckdb
import pytest

from pyspark.sql import functions as F

from quern.functions.text import cell_name
from quern.operators import likeness


def words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(n // 3)]
    out = set(base)
    for w in base * 2:
        k = rng.randrange(len(w))
        out.add(w[:k] + rng.choice(["", "a", "xy", "e"]) + w[k + rng.randrange(2) :])
    return sorted(out - {""})


@pytest.mark.parametrize("least", [0.6, 0.86, 1.0])
def test_ratio_pairs_equal_all_pairs(spark, least):
    one, two = words(1, 90), words(2, 60)
    table = lambda ws: spark.createDataFrame([(w, w) for w in [*ws, "", None]], "id string, text string")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    got = {(r["a"], r["b"]): r["ratio"] for r in likeness.ratio_pairs(table(one), least=least).collect()}
    assert got == {(a, b): ratio(a, b) for a in one for b in one if a < b and ratio(a, b) >= least}
    got = {(r["a"], r["b"]): r["ratio"] for r in likeness.ratio_pairs(table(one), table(two), least=least).collect()}
    assert got == {(a, b): ratio(a, b) for a in one for b in two if ratio(a, b) >= least}
    assert likeness.ratio_pairs(table([]).limit(0), least=least).count() == 0


def test_ratio_in_sql():
    pairs = [(a, b) for a in words(3, 45) for b in words(4, 30)]
    values = ", ".join(f"('{a}', '{b}', '{a}', '{b}')" for a, b in pairs)
    got = {(x, y): r for x, y, r in duckdb.sql(f"WITH RECURSIVE p AS (SELECT * FROM (VALUES {values}) v(x, y, tx, ty)), {likeness.ratio_sql('p')} SELECT x, y, ratio FROM ratios").fetchall()}
    assert got == {(a, b): pytest.approx(difflib.SequenceMatcher(None, a, b).ratio()) for a, b in pairs}


def test_close_matches_and_labels(spark):
    known, asked = words(5, 60), words(6, 30)
    got: dict = {}
    for r in likeness.close_matches(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w,) for w in known], "text string")).orderBy("word", "rank").collect():
        got.setdefault(r["word"], []).append(r["match"])
    assert got == {w: m for w in asked if (m := difflib.get_close_matches(w, known))}
    labels = spark.createDataFrame([("Cost of Goods",), ("cost-of-goods",), ("Costs of goods",), ("Goods",), ("good",), ("abc",), ("abcd x",), ("!!",), (None,)], "label string")
    near = {(r["a"], r["b"]): r["why"] for r in likeness.near_labels(labels).collect()}
    assert near[("Cost of Goods", "cost-of-goods")] == "equal" and near[("Cost of Goods", "Costs of goods")] == "alike" and near[("Goods", "cost-of-goods")] == "contained" and near[("Goods", "good")] == "contained"
    assert not any("abc" in p or "!!" in p for p in near)


def test_governed_match(spark):
    entries = spark.createDataFrame([("e1", ["Net sales", "x"]), ("e2", ["margn"]), ("e3", ["nothing like it"]), ("e4", None)], "entry string, names array<string>")
    catalogue = spark.createDataFrame([("net_sales", ["net_sales", "net sales"]), ("margin", ["margin"])], "key string, names array<string>")
    got = {r["entry"]: (r["governed"], r["state"]) for r in likeness.governed_match(entries, catalogue).collect()}
    assert got == {"e1": ("net_sales", "yes"), "e2": ("margin", "candidate"), "e3": (None, "no"), "e4": (None, "no")}


def test_cell_names_to_the_last_column(spark):
    def name(k):
        out = ""
        while k >= 0:
            out, k = chr(65 + k % 26) + out, k // 26 - 1
        return out

    got = {r["id"]: r["n"] for r in spark.range(0, 16_384, 1).select("id", cell_name(F.lit(2), F.col("id")).alias("n")).collect()}
    assert got == {k: f"{name(k)}3" for k in range(16_384)} and got[16_383] == "XFD3"
