"""``.xlsx`` scan: ``binaryFile`` over the workbooks, one workbook per task via ``mapInPandas``.

A workbook is a zip of XML parts; the first sheet is read with the standard library
(shared strings, inline strings, numbers, booleans), the first row is the header. Each task
parses only its own files, so a directory of many workbooks scans in parallel. Values
arrive as strings and are typed like CSV (pandas missing tokens → NULL, then
bigint / double / boolean / string by one aggregation pass).
"""

from __future__ import annotations

import io as _io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(_REL)
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels:
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


def read_sheet_rows(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet as lists of cell strings (None for empty cells)."""
    z = zipfile.ZipFile(_io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in sst.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    sheet = ET.fromstring(z.read(_first_sheet_path(z)))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            kind = c.get("t")
            v = c.find("m:v", _NS)
            if kind == "s" and v is not None:
                val = shared[int(v.text)]
            elif kind == "inlineStr":
                val = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif kind == "b" and v is not None:
                val = "True" if v.text == "1" else "False"
            else:
                val = v.text if v is not None else None
            cells[_col_index(c.get("r"))] = val
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


def scan_excel(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """First sheet of every ``.xlsx`` under ``path``; header from each file's first row.

    All files must have the header of the first one, and no cell may lie beyond it; a file
    that differs fails, so that no cell is dropped or put under another column's name.
    """
    from reviewlens.sources.io import NA_TOKENS, _typed, infer_csv_types

    import json

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def header_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                yield pd.DataFrame({"h": [json.dumps([str(h) for h in read_sheet_rows(bytes(blob))[0]])]})
                return

    # only the header row of one workbook reaches the driver
    first = files.select("content").limit(1).mapInPandas(header_of, "h string").first()
    if first is None:
        raise ValueError(f"no .xlsx workbook under {path}")
    header = json.loads(first[0])
    schema = ", ".join(f"`{h}` string" for h in header)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                head, *rows = read_sheet_rows(bytes(blob)) or [[]]
                if [str(h) for h in head] != header:
                    raise ValueError(f"a workbook has the header {head}, the first one has {header}")
                width = len(header)
                if any(len(r) > width for r in rows):
                    raise ValueError("a row has cells beyond the header")
                body = [r + [None] * (width - len(r)) for r in rows]
                yield pd.DataFrame(body, columns=header, dtype=object)

    raw = files.select("content").mapInPandas(parse, schema)
    if not infer:
        return raw
    return _typed(raw, infer_csv_types(raw, NA_TOKENS), NA_TOKENS)
