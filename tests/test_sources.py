"""Cell grids, transcripts and headings on small literal inputs."""

from quern.sources import grids, transcripts

CELLS = "file string, sheet string, row int, cells array<string>"


def test_long_layout(spark):
    rows = [("f", "s", 0, ["Report", None]), ("f", "s", 1, ["Branch  Name", "# of Records", "NPS"]), ("f", "s", 2, ["North", "1,000", "5%"]), ("f", "s", 3, ["Total", "9", "9"]), ("f", "s", 4, ["East", "x", "7"]), ("f", "s", 5, [None, " "]), ("f", "s", 6, ["West", "1", "1"])]
    got = grids.long_facts(spark.createDataFrame(rows, CELLS), dim="Branch Name", measures={"# of records": "records", "NPS": "nps", "absent": "no"})
    assert sorted((r["metric"], r["entity"], r["value"]) for r in got.collect()) == [("nps", "East", 7.0), ("nps", "North", 5.0), ("records", "North", 1000.0)]


def test_matrix_layout(spark):
    rows = [("f", "s", 0, ["Title"]), ("f", "s", 1, ["Metric", "January 2026", "Feb 2026", "January 2026"]), ("f", "s", 2, ["Calls", "5", "6", "7"]), ("f", "s", 3, ["Calls", "8", None, "9"])]
    got = grids.matrix_facts(spark.createDataFrame(rows, CELLS))
    assert sorted((r["metric"], r["month"], r["value"]) for r in got.collect()) == [("Calls", "2026-01", 5.0), ("Calls", "2026-02", 6.0)]


def test_wide_layout(spark):
    rows = [("f", "s", 0, ["", "March 2026", "", "Total", "", "April 2026"]), ("f", "s", 1, ["Site", "Qty", "Rate", "Qty", "Rate", "Qty"]), ("f", "s", 2, ["A", "1", "2", "3", "4", "5"]), ("f", "s", 3, ["all", "1", "1", "1", "1", "1"])]
    got = grids.wide_month_facts(spark.createDataFrame(rows, CELLS), dim="site", measures={"Qty": "qty", "Rate": "rate"})
    assert sorted((r["metric"], r["entity"], r["month"], r["value"]) for r in got.collect()) == [("qty", "A", "2026-03", 1.0), ("qty", "A", "2026-04", 5.0), ("rate", "A", "2026-03", 2.0)]


def test_annotations(spark):
    note = "This figure was restated after the audit of March."
    rows = [("f", "s", 0, ["a", "1", None, note]), ("f", "s", 1, ["b", "2", None, None]), ("f", "s", 2, [note, "3", None, None])]
    assert [(r["row"], r["col"]) for r in grids.annotation_cells(spark.createDataFrame(rows, CELLS)).collect()] == [(0, 3)]


def test_cues(spark):
    vtt = "WEBVTT\n\nNOTE made up\n\nab12-0\n00:00:01.000 --> 00:00:02.000\n<v Ann>Hello\n\nab12-1\n00:00:02.000 --> 00:00:03.500\n<v Ann>there <b>you</b>\n\n00:01:00.000 --> 00:01:01.000\n  \n"
    srt = "1\r\n00:00:05,250 --> 00:00:06,000\r\nBob: fine\r\nthanks\r\n"
    got = transcripts.cues(spark.createDataFrame([("v", vtt), ("s", srt)], "source string, text string")).collect()
    assert sorted((r["source"], r["start"], r["speaker"], r["text"]) for r in got) == [("s", 5.25, "Bob", "fine thanks"), ("v", 1.0, "Ann", "Hello there you")]


def test_headings_and_sections(spark):
    md = "# A\nintro\n## B\nx1\nx2\n### C\n# D\n" + "y" * 30
    df = spark.createDataFrame([(1, md)], "id long, text string")
    got = {r["line"]: (r["breadcrumb"], r["parent"]) for r in transcripts.headings(df, "id", "text").collect()}
    assert got["x1"] == ("A > B", "A") and got["### C"] == ("A > B > C", "B") and got["# D"] == ("D", None)
    parts = transcripts.sections(df, "id", "text", 3).orderBy("ord").collect()
    assert [(r["ord"], r["title"], r["text"]) for r in parts] == [(0, "A", "intro"), (1, "B", "x1"), (2, "B (part 2)", "x2"), (3, "D", "y" * 30)]
