"""Folders of ``.xlsx`` workbooks as tables, one workbook per task step.

A workbook is a zip of XML parts. The format caps a sheet at 1,048,576 rows,
and rows are read as a stream, so a task never holds a decoded sheet.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from functools import cached_property
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# XML names and part names of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORKBOOK, _LINKS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels"
_STRINGS, _STYLES = "xl/sharedStrings.xml", "xl/styles.xml"

# Built-in number formats that show a date, and day zero.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_DAY_ZERO = datetime(1899, 12, 30)
ROWS_PER_SHEET = 1_048_576

ROW_SCHEMA = "source_path string, sheet_index int, sheet string, row_no long, cells array<string>"
SHEET_SCHEMA = "source_path string, sheet_index int, sheet string"
_BATCH = 10_000
_UNREADABLE = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, EOFError)


# The reader travels with the tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Book:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        links = {
            r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(self.zip.read(_LINKS))
        }
        root = ElementTree.fromstring(self.zip.read(_WORKBOOK))
        self.sheets = [
            (s.get("name"), self._part(links[s.get(_LINK)])) for s in root.iter(f"{_MAIN}sheet") if s.get(_LINK) in links
        ]

    @staticmethod
    def _part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    @cached_property
    def _texts(self) -> list[str]:
        if _STRINGS not in self.zip.namelist():
            return []
        root = ElementTree.fromstring(self.zip.read(_STRINGS))
        return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.iter(f"{_MAIN}si")]

    @cached_property
    def _date_styles(self) -> set[int]:
        if _STYLES not in self.zip.namelist():
            return set()
        root = ElementTree.fromstring(self.zip.read(_STYLES))
        own = {}
        for f in root.iter(f"{_MAIN}numFmt"):
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower()
            own[int(f.get("numFmtId", 0))] = any(letter in code for letter in "ymdhs")
        formats = root.find(f"{_MAIN}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
        return {i for i, n in enumerate(ids) if own.get(n, n in _DATE_FORMATS)}

    def rows(self, part: str) -> Iterator[list[str | None]]:
        with self.zip.open(part) as stream:
            data = None
            for event, element in ElementTree.iterparse(stream, events=("start", "end")):
                if event == "start":
                    data = element if element.tag == f"{_MAIN}sheetData" else data
                elif element.tag == f"{_MAIN}row":
                    cells: list[str | None] = []
                    for c in element:
                        place = _column(c.get("r", "")) if c.get("r") else len(cells)
                        cells.extend([None] * (place - len(cells)))
                        cells.append(_cell(c, self._texts, self._date_styles))
                    yield cells
                    if data is not None:
                        data.clear()  # rows that were read stay nowhere

    def width(self, part: str) -> int:
        """Columns of a sheet: as its dimension says, else as its longest row has."""
        with self.zip.open(part) as stream:
            for event, element in ElementTree.iterparse(stream, events=("start", "end")):
                if event == "end" and element.tag == f"{_MAIN}dimension":
                    return _column(element.get("ref", "").split(":")[-1]) + 1
                if event == "start" and element.tag == f"{_MAIN}sheetData":
                    break
        return max((len(cells) for cells in self.rows(part)), default=0)


def header_names(cells: Sequence[str | None], width: int = 0) -> list[str]:
    """Column names of a header row: an empty cell is ``Unnamed: <place>``, a repeated name gets ``.1``, ``.2`` and so on."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for place in range(max(len(cells), width)):
        name = cells[place] if place < len(cells) and cells[place] else f"Unnamed: {place}"
        if name in seen:
            number = seen[name]
            while f"{name}.{number}" in seen:
                number += 1
            seen[name] = number + 1
            name = f"{name}.{number}"
        seen[name] = 1
        names.append(name)
    return names


def _column(reference: str) -> int:
    n = 0
    for letter in reference:
        if not letter.isalpha():
            break
        n = n * 26 + ord(letter.upper()) - 64
    return n - 1


def _cell(c: ElementTree.Element, texts: list[str], dates: set[int]) -> str | None:
    kind = c.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    value = c.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return texts[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "e":
        return None  # an error cell has no value
    if kind is None and int(c.get("s", -1)) in dates:
        moment = _DAY_ZERO + timedelta(microseconds=round(float(value.text) * 86_400e6))
        return moment.isoformat(sep=" ")
    return value.text


def read_workbooks(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """The workbooks below a folder in the shape of Spark's binary file source."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))
    )


def _opened(frame: pd.DataFrame, skip: bool) -> Iterator[tuple[str, _Book]]:
    for path, content in zip(frame["path"], frame["content"], strict=True):
        try:
            book = _Book(content)
        except _UNREADABLE:
            if not skip:
                raise
            continue
        yield path, book


def workbook_errors(books: DataFrame) -> DataFrame:
    """``source_path, error`` of workbooks that cannot be read; the readers pass them over with ``skip_unreadable``."""

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    _Book(content)
                except _UNREADABLE as error:
                    found.append((path, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(found, columns=["source_path", "error"])

    return books.select("path", "content").mapInPandas(errors, "source_path string, error string")


def sheet_names(books: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """``source_path, sheet_index, sheet`` of every sheet of every workbook."""

    def names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, i, name) for path, book in _opened(frame, skip_unreadable) for i, (name, _) in enumerate(book.sheets)]
            yield pd.DataFrame(rows, columns=["source_path", "sheet_index", "sheet"])

    return books.select("path", "content").mapInPandas(names, SHEET_SCHEMA)


def sheet_rows(books: DataFrame, sheet: str | int | None = 0, skip_unreadable: bool = False) -> DataFrame:
    """Rows of one sheet per workbook, or of all sheets with ``sheet=None``.

    ``row_no`` 0 is the header. A sheet that a workbook lacks is replaced by
    its first one.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, book in _opened(frame, skip_unreadable):
                for i, (name, part) in enumerate(book.sheets):
                    if sheet is not None and i != _chosen(book.sheets, sheet):
                        continue
                    batch: list[tuple] = []
                    for n, cells in enumerate(book.rows(part)):
                        batch.append((path, i, name, n, cells))
                        if len(batch) == _BATCH:
                            yield pd.DataFrame(batch, columns=_row_columns())
                            batch = []
                    if batch:
                        yield pd.DataFrame(batch, columns=_row_columns())

    return books.select("path", "content").mapInPandas(rows, ROW_SCHEMA)


def _row_columns() -> list[str]:
    return ["source_path", "sheet_index", "sheet", "row_no", "cells"]


def _chosen(sheets: Sequence[tuple], sheet: str | int) -> int:
    if isinstance(sheet, int):
        return sheet if 0 <= sheet < len(sheets) else 0
    return next((i for i, (name, _) in enumerate(sheets) if name == sheet), 0)


def sheet_heads(books: DataFrame, sheet: str | int = 0, skip_unreadable: bool = False) -> DataFrame:
    """``source_path, names``: the column names of each workbook's sheet."""

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path, book in _opened(frame, skip_unreadable):
                part = book.sheets[_chosen(book.sheets, sheet)][1] if book.sheets else None
                first = next(book.rows(part), None) if part else None
                if first is not None:
                    found.append((path, header_names(first, book.width(part))))
            yield pd.DataFrame(found, columns=["source_path", "names"])

    return books.select("path", "content").mapInPandas(heads, "source_path string, names array<string>")


def sheet_table(
    books: DataFrame, sheet: str | int = 0, columns: Sequence[str] | None = None, skip_unreadable: bool = False
) -> DataFrame:
    """One text column per header, matched by header name across workbooks, plus ``source_path``.

    Repeated and empty headers, and columns beyond the header row, are named
    as ``header_names`` says, so that every column is kept. Without
    ``columns`` the headers are collected first: one short row per workbook,
    folded to the distinct names. A corpus of very many unlike headers should
    name its columns, or use ``sheet_rows``.
    """
    if columns is None:
        found = sheet_heads(books, sheet, skip_unreadable).select(F.posexplode("names").alias("place", "name"))
        order = found.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()
        columns = [r["name"] for r in order]
    names = list(columns)
    own_path = "source_path"
    while own_path in names:
        own_path += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [own_path, *names]])

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, book in _opened(frame, skip_unreadable):
                if not book.sheets:
                    continue
                lines = book.rows(book.sheets[_chosen(book.sheets, sheet)][1])
                head = next(lines, [])
                own = {n: p for p, n in enumerate(header_names(head, len(head) + len(names)))}
                places = [own.get(n, -1) for n in names]
                batch: list[tuple] = []
                for cells in lines:
                    batch.append((path, *[cells[p] if 0 <= p < len(cells) else None for p in places]))
                    if len(batch) == _BATCH:
                        yield pd.DataFrame(batch, columns=schema.names)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=schema.names)

    return books.select("path", "content").mapInPandas(tables, schema)
