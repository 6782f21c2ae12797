"""Workbooks written by hand, layouts without a template, alike frames against brute force, groups of labels and hedged quotes."""

import io
import itertools
import random
import zipfile

from quern.operators import matching
from quern.sources import grids, workbooks

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def book(sheet2="<worksheet/>", date1904=""):
    sheet = f"""<worksheet xmlns="{M}"><dimension ref="A1:D9"/><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in </t></is></c></row>
<row r="2"><c r="B2"><v>3</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2" s="2"><v>45292.5</v></c></row>
<row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5"><v>0.5</v></c><c r="C5" t="e"><v>#N/A</v></c><c r="AA5" t="str"><f>1</f><v>x</v></c><c r="AB5"/></row>
</sheetData></worksheet>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}"><workbookPr {date1904}/><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/s1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}"><si><r><t>Na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{M}"><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot; hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", sheet)
        z.writestr("xl/worksheets/s2.xml", sheet2)
    return out.getvalue()


def test_workbook_cells_and_errors(spark):
    f = spark.createDataFrame([("a.xlsx", bytearray(book())), ("b.xlsx", bytearray(b"no zip")), ("c.xlsx", None), ("d.xlsx", bytearray(book(sheet2="<worksheet>", date1904='date1904="1"')))], "path string, content binary")
    got = workbooks.read_workbooks(f).collect()
    cells = {(r["sheet"], r["row"]): r["cells"] for r in got if r["file"] == "a.xlsx"}
    assert cells == {("One", 1): ["Name", None, "in "], ("One", 2): [None, "3", "2024-01-01", "2024-01-01 12:00:00"], ("One", 3): [], ("One", 5): ["true", "0.5", "#N/A", *[None] * 23, "x", None]}
    assert {(r["file"], r["sheet"]): r["error"].split(":")[0] for r in got if r["error"]} == {("b.xlsx", None): "BadZipFile", ("d.xlsx", "Two"): "ParseError"}
    assert next(r["cells"][2] for r in got if r["file"] == "d.xlsx" and r["row"] == 2) == "2028-01-02"
    assert workbooks.read_workbooks(f.limit(0)).count() == 0


def test_workbook_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(book())
    (tmp_path / "in" / "a.txt").write_text("x")
    got = workbooks.workbooks(spark, str(tmp_path))
    assert {r["file"].rsplit("/", 1)[-1] for r in got.collect()} == {"a.xlsx"}
    assert rows(grids.sheet_profiles(got).select("sheet", "n_rows", "header_row"))[0][:2] == ("One", 4)


def test_tolerant_layout(spark):
    g = [["junk"], ["Region", "Branch", "Score", "Other"], ["N", "NE1: Ann", "5", None], ["N", "NE2", "$1,000", "x"], [], ["N", "Total", "9"], ["N", None, "9"], ["N", "NE3", "n/a"]]
    c = spark.createDataFrame([("f", "s", i, x) for i, x in enumerate(g)] + [("f", "empty", 0, None), ("f", "none", 0, ["Region"])], "file string, sheet string, row long, cells array<string>")
    got = grids.tolerant_facts(c, dims={"region": ["region"], "branch": ["site", "branch"]}, measures={"score": "nps", "absent": "z"}, entity=r"([A-Z0-9]+):")
    assert rows(got.select("row", "grain", "metric", "entity", "value")) == [(2, "branch", "nps", "NE1", 5.0), (3, "branch", "nps", "NE2", 1000.0)]
    assert grids.tolerant_facts(c.limit(0), dims={"r": ["r"]}, measures={"s": "s"}).count() == 0
    p = {r["sheet"]: (r["n_rows"], r["n_cols"], r["header_row"], r["columns"], r["samples"]) for r in grids.sheet_profiles(c, samples=2).collect()}
    assert p["s"] == (8, 4, 1, ["Region", "Branch", "Score", "Other"], ["N | NE1: Ann | 5 | ", "N | NE2 | $1,000 | x"])
    assert p["none"][2:] == (None, None, None)


def test_redundant_pairs_equal_brute_force(spark):
    rnd = random.Random(3)
    base = [f"word{i}" for i in range(60)]
    docs = []
    for i in range(60):
        ws = rnd.sample(base[: 20 + i % 3], 16 + i % 3)
        docs.append((i, " ".join(ws)))
    docs += [(100, docs[0][1].upper()), (101, None), (102, ""), (103, "too short")]
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"], r["score"]) for r in matching.redundant_pairs(spark.createDataFrame(docs, "id long, body string")).collect()}
    sets = {}
    for i, t in docs:
        s = frozenset((t or "").lower().split())
        if len(s) >= 15:
            sets.setdefault(s, []).append(i)
    want = {}
    for (x, ix), (y, iy) in itertools.combinations(sets.items(), 2):
        s = len(x & y) / len(x | y)
        if s >= 0.75:
            (a, na), (b, nb) = sorted([(min(ix), len(ix)), (min(iy), len(iy))])
            want[a, b] = (na, nb, round(s, 3))
    assert got == want and len(want) > 5


def test_anchors_and_modality(spark):
    m = spark.createDataFrame([("g", "a", 0), ("g", "b", 1), ("g", "c", 2), ("g", "c", 2), ("h", "z", 0)], "group string, member string, pos int")
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "a"), (1, "a"), (None, "c")], "chunk_id long, category_id string")
    assert rows(matching.cluster_anchors(m, t)) == [("g", "a", 2, "a", None), ("g", "b", 2, "a", 1), ("g", "c", 1, "a", 0), ("h", "z", 0, "z", None)]
    c = spark.createDataFrame([(1, "It ships"), (2, "Bob said it ships"), (3, "Ships? "), (4, None)], "claim long, text string")
    q = spark.createDataFrame([(i, k, s) for i in (1, 2, 3, 4) for k, s in enumerate(["I think maybe so", "Really?", "Maybes", None, "I think so"])], "claim long, tag int, quote string")
    assert rows(matching.modality_flags(c, q, hedges=["maybe", "i think"], keeps=["said"])) == [(i, k, x) for i in (1, 4) for k, x in ((0, "i think"), (1, "?"), (4, "i think"))]
