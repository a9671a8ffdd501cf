"""Previews of workbooks: sheets, first rows, headers, merged ranges and formulas."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SHEETS, ROWS, COLUMNS, RANGES = 8, 16, 14, 20
SCHEMA = "path string, name string, rows int, header array<string>, sample array<array<string>>, merged array<string>, formulas array<string>, problem string"
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(letters: str) -> int:
    """A column's number from 1: A is 1, Z 26, AA 27."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def _value(cell, shared: list[str]) -> str:
    kind, v = cell.get("t"), cell.find(f"{_M}v")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in cell.iter(f"{_M}t"))
    elif v is None or v.text is None:
        text = ""
    elif kind == "s":
        text = shared[int(v.text)] if int(v.text) < len(shared) else ""
    else:
        text = {"0": "FALSE", "1": "TRUE"}.get(v.text, v.text) if kind == "b" else v.text
    return " ".join(text.split())


def preview(content: bytes) -> Iterator[dict]:
    """A row for each of a workbook's first sheets; what can't be read is one row with its problem."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
            targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for sheet in list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"))[:SHEETS]:
                target = targets.get(sheet.get(_R), "")
                file = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if file not in names:
                    yield {"name": sheet.get("name"), "problem": f"no {file}"}
                    continue
                root = ElementTree.fromstring(z.read(file))
                filled, formulas, n = [], [], 0
                for row in root.iter(f"{_M}row"):
                    cells = {}
                    for cell in row.iter(f"{_M}c"):
                        if cell.find(f"{_M}f") is not None:
                            formulas.append(cell.get("r", ""))
                        at = column_number(re.sub("[^A-Za-z]", "", cell.get("r", "")) or "A")
                        if at <= COLUMNS and (text := _value(cell, shared)):
                            cells[at] = text
                    if cells:
                        n += 1
                        if len(filled) < ROWS:
                            filled.append([cells.get(i, "") for i in range(1, max(cells) + 1)])
                header = next((r for r in filled[:5] if sum(map(bool, r)) >= 2), filled[0] if filled else [])
                merged = [m.get("ref", "") for m in root.iter(f"{_M}mergeCell")][:RANGES]
                yield {"name": sheet.get("name"), "rows": n, "header": header, "sample": filled, "merged": merged, "formulas": formulas[:RANGES]}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
        yield {"problem": type(e).__name__}


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Previews of all .xlsx files below a path, files being read where Spark puts them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    columns = [f.split()[0] for f in re.split(r", (?=\w+ )", SCHEMA)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                rows = [{"path": path_, **row} for row in preview(content)]
                yield pd.DataFrame({c: [r.get(c) for r in rows] for c in columns}).astype({"rows": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
