"""Workbooks (xlsx) as cells: rows (file, sheet, row, cells ARRAY<STRING>, error), which :mod:`quern.sources.grids` turns into facts.

A workbook is one zip and is read by one task; its sheets stream row by row.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, sheet string, row long, cells array<string>, error string"
BATCH = 4096  # rows of cells that a worker hands on at once

# Numbers of the format's built-in date and time formats.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node) -> str:
    """The text of a string item: its runs, without the reading aids of phonetic runs."""
    if _local(node.tag) == "t":
        return node.text or ""
    return "".join(_text(x) for x in node if _local(x.tag) in ("t", "r"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if _local(node.tag) == "si":
                out.append(_text(node))
                node.clear()
    return out


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows numbers as dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for x in root.iter():
        if _local(x.tag) == "numFmt":
            bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", ""))
            own[int(x.get("numFmtId", "0"))] = bool(re.search("[dmyhs]", bare, re.IGNORECASE))
    styles = next((x for x in root if _local(x.tag) == "cellXfs"), ())
    return [own.get(n, n in DATE_FORMATS) for n in (int(x.get("numFmtId", "0")) for x in styles)]


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], datetime]:
    """(name, path in the zip) of the sheets in order, and the day that dates count from."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found, origin = [], datetime(1899, 12, 30)
    for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true"):
            origin = datetime(1904, 1, 1)
        if _local(x.tag) == "sheet":
            link = next(v for k, v in x.attrib.items() if _local(k) == "id" and k != "id")
            target = links[link]
            found.append((x.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return found, origin


def _value(cell, shared: list[str], dated: list[bool], origin: datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(x) for x in cell if _local(x.tag) == "is")
    raw = next((x.text for x in cell if _local(x.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind != "n":
        return raw
    number, style = float(raw), int(cell.get("s", "0"))
    if style < len(dated) and dated[style]:
        at = origin + timedelta(seconds=round(number * 86400))
        return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")
    return str(int(number)) if number.is_integer() and abs(number) < 2**53 else repr(number)


def _column(ref: str) -> int:
    """The column of a reference such as ``AB12``, from 0."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _rows(stream, shared, dated, origin) -> Iterator[tuple[int, list[str | None]]]:
    """(row, cells) of a sheet; of a gap between rows the first is given, without cells."""
    last = 0
    parents = []
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(node)
            continue
        parents.pop()
        if _local(node.tag) != "row":
            continue
        row = int(node.get("r", last + 1))
        if row > last + 1:
            yield last + 1, []
        cells: list[str | None] = []
        for cell in node:
            if _local(cell.tag) == "c":
                at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(cell, shared, dated, origin)
        yield row, cells
        last = row
        parents[-1].remove(node)


def _read(path: str, content: bytes) -> Iterator[tuple]:
    """The rows of a workbook; what can't be read gives one row with the error, a sheet or the whole."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        (sheets, origin), shared, dated = _sheets(book), _shared(book), _dated(book)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, StopIteration) as e:
        yield path, None, None, None, f"{type(e).__name__}: {e}"
        return
    for name, part in sheets:
        try:
            with book.open(part) as stream:
                for row, cells in _rows(stream, shared, dated, origin):
                    yield path, name, row, cells, None
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, OverflowError) as e:
            yield path, name, None, None, f"{type(e).__name__}: {e}"


def read_workbooks(files: DataFrame) -> DataFrame:
    """Cells of workbooks (path, content): values as text, dates as ``yyyy-MM-dd`` with a time if there is one; gaps between cells are null.

    A workbook or sheet that can't be read is one row with ``error``; null contents give none. Empty table: empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "sheet", "row", "cells", "error"]
        held = []
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                for r in _read(path, bytes(content)):
                    held.append(r)
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=names).astype({"row": "Int64"})
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names).astype({"row": "Int64"})

    return files.select("path", "content").filter("content is not null").mapInPandas(run, SCHEMA)


def workbooks(spark: SparkSession, root: str, *, include: str = "*.xlsx") -> DataFrame:
    """:func:`read_workbooks` of every file under ``root`` that fits ``include``; Spark gives a task as many files as ``spark.sql.files.maxPartitionBytes`` allows."""
    return read_workbooks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(root))
