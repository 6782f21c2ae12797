"""Files in and out, and small text functions."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.sources import files


def test_corpus_logs_and_exports(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_bytes(b"# T\n\nbody \xff")
    (root / "sub" / "call.VTT").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v Ann>hello</v>\n")
    (root / "sub" / "x.bin").write_text("")
    c = files.corpus(spark, str(root), exclude=r"\.bin$")
    assert sorted((r["path"], r["kind"]) for r in c.collect()) == [("a.md", "markdown"), ("sub/call.VTT", "cues")]
    assert "body" in c.filter("path = 'a.md'").first()["text"]
    assert [(r["speaker"], r["text"]) for r in files.transcript_cues(c).collect()] == [("Ann", "hello")]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n[1]\n{"a": "x"}\n\n{"a": 3, "b": 2}\n{"a":')
    assert [(r["seq"], r["a"]) for r in files.event_log(spark, str(tmp_path / "log.jsonl"), "a int").orderBy("seq").collect()] == [(0, 1), (5, 3)]
    out = str(tmp_path / "log-folder")
    for k in (1, 2):
        files.append_log(spark.createDataFrame([(k,)], "a int"), out)
    assert sorted(r["a"] for r in spark.read.schema("a int").json(out).collect()) == [1, 2]


def test_tables_are_replaced_whole_or_written_once(spark, tmp_path):
    p = str(tmp_path / "t")
    for n in (3, 2):
        files.write_marts({"m": spark.range(n)}, p)
        assert spark.read.parquet(f"{p}/m").count() == n
    assert [x.name for x in (tmp_path / "t").iterdir() if not x.name.startswith(".")] == ["m"]
    files.write_once(spark.range(1), f"{p}/v1")
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_once(spark.range(1), f"{p}/v1")
    rows = [("s", 2, "T", "two", None, None), ("s", 1, None, "one", "ACTIVE", None), ("s", 3, "", "gone", "SUPERSEDED", "c"), ("u", 1, "H", None, None, "c")]
    files.export_documents(spark.createDataFrame(rows, "source string, ord int, title string, text string, status string, category string"), f"{p}/md", category=True)
    got = {(r["category"], r["source"]): r["value"] for r in spark.read.text(f"{p}/md", wholetext=True).collect()}
    assert {k: v.rstrip("\n") for k, v in got.items()} == {("none", "s"): "one\n\n## T\n\ntwo", ("c", "u"): "## H"}


def test_audit_and_images(spark):
    f = spark.createDataFrame([("a", "x", "2026-01"), ("a", "x", "2026-02"), ("b", None, None)], "family string, entity string, month string")
    u = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "partial"), ("c", 3, None)], "family string, unit int, state string")
    assert sorted(tuple(r) for r in files.build_audit(f, u).collect()) == [("a", 2, 1, 1, 0, 2, 2, 1), ("b", 0, 0, 0, 0, 1, 0, 0), ("c", 1, 0, 0, 0, 0, 0, 0)]
    s = spark.createDataFrame([("d", 0, "x", None), ("d", 1, " ", "i1"), ("d", 2, "y", None), ("d", 3, "z", "i2"), ("e", 0, "w", None)], "source string, ord int, text string, image string")
    assert sorted((r["source"], r["ord"], r["image"]) for r in files.carried_images(s).collect()) == [("d", 0, None), ("d", 2, "i1"), ("d", 3, "i2"), ("e", 0, None)]


def test_small_functions(spark):
    r = spark.range(1).select(
        tx.cell_name(F.lit(2), F.lit(1)).alias("b3"), tx.cell_name(F.lit(0), F.lit(27)).alias("ab1"), tx.hamming(F.lit(5), F.lit(-1).cast("long")).alias("h"), tx.mean_abs(F.array(F.lit(1), F.lit(4)), F.array(F.lit(2), F.lit(2))).alias("m"),
        tx.parts(F.lit(" a | |b"), "|").alias("p"), tx.utc(F.lit("2026-03-01T10:00:00+02:00")).alias("u"), tx.utc(F.lit("no")).alias("n"), tx.smart_title(F.lit("NORTH EAST SE of")).alias("t"),
        (tx.identity(b=F.lit(1), a=F.lit("x")) == tx.identity(a=F.lit("x"), b=F.lit(1))).alias("same"), tx.identity(a=F.lit(None).cast("string")).alias("i"),
        tx.difference_hash(F.array(*[F.array(*[F.lit(k % 2) for k in range(9)])] * 8)).alias("d"),
    ).first()
    assert (r["b3"], r["ab1"], r["h"], r["m"], r["p"], r["u"], r["n"], r["t"], r["same"], len(r["i"])) == ("B3", "AB1", 62, 1.5, ["a", "b"], "2026-03-01T08:00:00Z", None, "North East SE of", True, 16)
    assert r["d"] & 0xFF == 0b10101010
