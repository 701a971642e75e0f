"""Rows of a table as ``.xlsx`` files, for queries and tests that need workbooks to read."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, datetime, timedelta
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.functions import col, family
from tallyframe.sources.workbooks import ROWS_PER_SHEET

# Part names of the workbook format, and its day zero.
_WORKBOOK, _LINKS, _STYLES = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml"
_DAY_ZERO = datetime(1899, 12, 30)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def encode_workbooks(df: DataFrame, sheet: str = "Sheet1", rows_per_book: int = 100_000, headers: Sequence[str] | None = None) -> DataFrame:
    """Rows as workbooks, ``path, content``: as many per task as its rows need.

    Numbers and booleans keep their type, dates become date cells, and texts
    are stored inline.
    """
    if not 0 < rows_per_book < ROWS_PER_SHEET:
        raise ValueError(f"rows_per_book must be between 1 and {ROWS_PER_SHEET - 1}")
    kinds = {f.name: family(f.dataType) for f in df.schema.fields}
    shown = df.select(
        [col(c) if kinds[c] in ("integer", "float", "numeric") else col(c).cast("string").alias(c) for c in df.columns]
    )
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def books(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, lines, names = 0, [], list(headers or kinds)

        def finished() -> pd.DataFrame:
            name = f"part-{task.partitionId():05d}-{number:05d}.xlsx"
            return pd.DataFrame({"path": [name], "content": [_book_bytes(sheet, names, lines)]})

        for frame in frames:
            for values in frame.itertuples(index=False, name=None):
                lines.append(_row_xml(values, kinds.values()))
                if len(lines) == rows_per_book:
                    yield finished()
                    number, lines = number + 1, []
        if lines:
            yield finished()

    return shown.mapInPandas(books, schema)


def _row_xml(values: Sequence, kinds: Sequence[str]) -> str:
    cells = []
    for value, kind in zip(values, kinds, strict=True):
        if value is None or value != value:
            cells.append("<c/>")
        elif kind == "numeric":
            cells.append(f'<c t="b"><v>{int(value)}</v></c>')
        elif kind in ("integer", "float"):
            cells.append(f"<c><v>{int(value) if kind == 'integer' else repr(float(value))}</v></c>")
        elif kind == "datetime":
            cells.append(f'<c s="1"><v>{_serial(value)!r}</v></c>')
        else:
            cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
    return "<row>" + "".join(cells) + "</row>"


def _serial(value: str | date) -> float:
    moment = datetime.fromisoformat(str(value))
    return (moment - _DAY_ZERO) / timedelta(days=1)


def _book_bytes(sheet: str, names: Sequence[str], lines: Sequence[str]) -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    packages = "http://schemas.openxmlformats.org/package/2006"
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = "<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(n)}</t></is></c>' if n else "<c/>" for n in names) + "</row>"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{packages}/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/>'
        f'<Override PartName="/xl/styles.xml" ContentType="{types}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{packages}/relationships">'
        f'<Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        _WORKBOOK: f'<workbook {main} xmlns:r="{rel}"><sheets>'
        f'<sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        _LINKS: f'<Relationships xmlns="{packages}/relationships">'
        f'<Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        _STYLES: f'<styleSheet {main}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{head}{''.join(lines)}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()
