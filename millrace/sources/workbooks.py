"""Spreadsheet workbooks: many XLSX files read as one table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROWS_PER_BATCH = 10_000
SOURCE_FILE = "source_file"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    """Text of a string item; phonetic hints are left out."""
    runs = [t for child in node if _local(child.tag) != "rPh" for t in child.iter() if _local(t.tag) == "t"]
    return "".join(t.text or "" for t in runs)


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = [n for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"]
    link = next(v for k, v in sheets[0].attrib.items() if _local(k) == "id")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(n.attrib["Target"] for n in links if n.attrib["Id"] == link)
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _cell_text(cell, shared: list[str]) -> str | None:
    kind = cell.attrib.get("t", "n")
    if kind == "inlineStr":
        return _texts(cell) or None
    value = next((v.text for v in cell if _local(v.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    return {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value


def sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """Non-blank rows of a workbook's first sheet as column number to text, read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if _local(node.tag) == "si":
                        shared.append(_texts(node))
                        node.clear()
        with book.open(_first_sheet(book)) as f:
            for _, node in ElementTree.iterparse(f):
                if _local(node.tag) != "row":
                    continue
                cells = {}
                for i, c in enumerate(node):
                    at = _column_index(c.attrib["r"]) if "r" in c.attrib else i
                    text = _cell_text(c, shared)
                    if text is not None:
                        cells[at] = text
                node.clear()
                if cells:
                    yield cells


def _header(cells: dict[int, str]) -> dict[int, str]:
    names: dict[int, str] = {}
    for at in range(max(cells) + 1):
        base = cells.get(at) or "column"
        name, n = base, 1
        while name in names.values():
            name, n = f"{base}_{n}", n + 1
        names[at] = name
    return names


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The column names of each workbook; its rows are not read."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            names = _header(next(sheet_rows(content), {0: ""}))
            yield pd.DataFrame({"file": path, "at": list(names), "key": list(names.values())})


def _parser(columns: list[str], fields: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = sheet_rows(content)
                place = {name: at for at, name in _header(next(rows, {0: ""})).items()}
                order, out, seen = [place.get(c) for c in columns], [], 0
                for seen, cells in enumerate(rows, 1):
                    out.append((*[cells.get(at) for at in order], path))
                    if len(out) == ROWS_PER_BATCH:
                        yield pd.DataFrame(out, columns=fields)
                        out = []
                if seen == 0:
                    raise ValueError(f"{path}: the first sheet has no rows")
                yield pd.DataFrame(out, columns=fields)

    return run


def workbook_rows(files: DataFrame) -> DataFrame:
    """Rows of workbooks given as ``path`` and ``content``: all columns as text plus ``source_file``.

    Each file is parsed by one task as a stream. The header row names the columns, a blank cell is null, and the table
    has the union of all files' columns in first-seen order.
    """
    books = files.select("path", "content")
    heads = books.mapInPandas(_heads, "file string, at int, key string")
    first = heads.groupBy("key").agg(F.min(F.struct("file", "at")).alias("first")).orderBy("first")
    columns = [r["key"] for r in first.collect() if r["key"] != SOURCE_FILE]
    fields = [f"c{i}" for i in range(len(columns) + 1)]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return books.mapInPandas(_parser(columns, fields), schema).toDF(*columns, SOURCE_FILE)


def load_workbooks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Read XLSX files (paths, folders or glob patterns) into one table."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return workbook_rows(files)
