"""Date phrases, task candidates, similar titles and claim continuity."""

from quern.functions import dates
from quern.operators import matching
from pyspark.sql import functions as F


def test_due_dates(spark):
    wed = "2026-03-11"  # a Wednesday
    cases = {
        "by 2026-04-02 please": "2026-04-02", "2026-02-30": None, "March 14": "2026-03-14", "the 14th of October": "2026-10-14", "25_Aug": "2026-08-25", "EOD": wed, "tomorrow": "2026-03-12",
        "on the 12th": "2026-03-12", "the 3rd": "2026-04-03", "mid week": wed, "middle of next week": "2026-03-18", "end of the week": "2026-03-13", "next week": "2026-03-20", "friday": "2026-03-13",
        "next friday": "2026-03-20", "wednesday": "2026-03-18", "next monday": "2026-03-16", "Decisions pending": None, "": None, None: None, "Feb 29": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("d", dates.due_date(F.col("t"), F.lit(wed).cast("date")).cast("string"))
    assert {r["t"]: r["d"] for r in df.collect()} == cases
    late = spark.range(1).select(dates.due_date(F.lit("Jan 5"), F.lit("2026-12-20").cast("date")).cast("string").alias("a"), dates.due_date(F.lit("tomorrow"), F.lit("2026-03-13").cast("date")).cast("string").alias("b"), dates.earliest_year(F.lit("v20261 from 2019, 2015 and 2024"), 2020).alias("y")).first()
    assert (late["a"], late["b"], late["y"]) == ("2027-01-05", "2026-03-16", 2015)


def test_candidates(spark):
    tasks = spark.createDataFrame([("t1", "ship the billing report", "2026-01-01"), ("t2", "billing", "2026-01-01"), ("t3", "billing billing", "2027-01-01"), ("t4", "garden", None)], "task_id string, text string, created string")
    msgs = spark.createDataFrame([(1, "Where is the billing report?", "2026-02-01"), (2, "see t4 and billing garden", "2026-02-01")], "msg_id long, text string, day string")
    got = [(r["msg_id"], r["task_id"]) for r in matching.task_candidates(msgs, tasks).orderBy("msg_id", "rank").collect()]
    assert got[0] == (1, "t1") and (1, "t3") not in got and got[[m for m, _ in got].index(2)] == (2, "t4")


def test_similar_titles(spark):
    n = spark.createDataFrame([("a", "task", "Send the report", "Billing"), ("b", "task", "send report now", "Billing"), ("c", "task", "other thing", None), ("d", "risk", "Send the report", None)], "node string, kind string, title string, parent_title string")
    got = {(r["node"], r["other"]): r["score"] for r in matching.similar_nodes(n, least=0.5).collect()}
    assert got == {("a", "b"): 0.75, ("b", "a"): 0.75}


def test_claims_keep_their_ids(spark):
    base = "- Alpha is **big** [RAG:1] <!-- c:aa11 -->\n- Beta rose 5% [RAG:2] <!-- c:bb22 -->\n\n```\n- code\n```\n\nA closing\nparagraph. <!-- c:cc33 -->\n- Gone soon <!-- c:dd44 -->"
    draft = "- Beta rose 5% [FILE:x.md] \n- Alpha is **big** [RAG:1] <!-- c:aa11 -->\n- Brand new statement here\n\nA closing -- paragraph!"
    mk = lambda b: matching.claims(spark.createDataFrame([("t", "s", b)], "task string, section string, body string"))
    rows = mk(base).orderBy("pos").collect()
    assert [(r["claim_id"], r["normalized"]) for r in rows] == [("aa11", "alpha is **big**"), ("bb22", "beta rose 5%"), ("dd44", "a closing paragraph. <!- c:cc33 -> - gone soon")]
    assert rows[0]["tags"] == ["[RAG:1]"]
    got = [(r["pos"], r["base_id"], r["category"]) for r in matching.match_claims(mk(base), mk(draft)).collect()]
    assert (0, "bb22", "recited") in got and (1, "aa11", "kept") in got and (2, None, "added") in got


def test_tags_and_months(spark):
    body = r"- seen [MART:a\]b] and [GRAPH:x] not [NOTE:y]"
    row = matching.claims(spark.createDataFrame([("t", "s", body)], "task string, section string, body string")).first()
    assert row["tags"] == [r"[MART:a\]b]", "[GRAPH:x]"] and row["normalized"] == "seen and not [note:y]"
    rows = spark.createDataFrame([("Sept 3",), ("marc 3",), ("9 May",), ("4 december",), ("jul 5",)], "t string").select(*dates.month_day(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(9, 3), (None, None), (5, 9), (12, 4), (7, 5)]


def test_dates_in_names(spark):
    cases = {
        "2026.10.19 sync": "2026-10-19", "10.19.2026_1101 sync": "2026-10-19", "19.10.2026.vtt": "2026-10-19", "05.04.2026": "2026-05-04", "call_20260302": "2026-03-02", "2025-12-31 a": "2025-12-31", "13.13.2026 x": None,
        "2026.13.40 on 2026-01-02": "2026-01-02", "25_Aug kickoff": "2025-08-25", "Mar 20": "2026-03-20", "April 9th": "2026-04-09", "Feb 29": None, "Marketing 5": None, "": None, None: None, "12026-01-02": "2026-01-02",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", dates.date_in_name(F.col("name"), F.lit("2026-03-11").cast("date")).cast("string").alias("d")).collect()
    assert {r["name"]: r["d"] for r in rows} == cases
    day = lambda s: F.lit(s).cast("date")
    short = spark.range(1).select(dates.short_date(day("2026-10-06"), day("2026-01-01")), dates.short_date(day("2023-10-16"), day("2026-01-01")), dates.short_date(day("2023-10-16"), day(None))).first()
    assert tuple(short) == ("Oct 6", "Oct 16, 2023", "Oct 16")
