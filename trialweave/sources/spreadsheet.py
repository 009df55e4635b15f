"""XLSX sheets: a header row, typed columns, dates as seconds from 1960.  Standard library only.

A workbook is a zip of XML that cannot be split, so a file is one task; cells leave it as text with a kind
(n number, d date, s text, e error) and are typed by Spark expressions.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.dates import excel_seconds
from ..model.missing import MIS_ERROR
from ..model.table import ROW, Table, mis
from .delimited import GUESS, header
from .normalise import RULES, text_cell, text_number_cells

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
#: Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def sheets(raw: bytes) -> dict[str, str]:
    """Sheet name -> part of the archive, in workbook order."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    return {s.get("name"): "xl/" + rels[s.get(f"{{{_NS['r']}}}id")].lstrip("/").removeprefix("xl/") for s in book.find("m:sheets", _NS)}


def _dates(z: zipfile.ZipFile) -> set[int]:
    """Style numbers whose format shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iterfind("m:numFmts/m:numFmt", _NS) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def rows(raw: bytes, sheet: str | None):
    """Rows of a sheet as lists of (text, kind); absent cells are (None, 's')."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    found = sheets(raw)
    part = found[sheet] if sheet else next(iter(found.values()))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    dates = _dates(z)
    with z.open(part) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{{{_NS['m']}}}row":
                continue
            out = []
            for i, c in enumerate(row):
                at = _column(c.get("r")) if c.get("r") else i
                out += [(None, "s")] * (at - len(out))
                v, t = c.find("m:v", _NS), c.get("t", "n")
                text = v.text if v is not None else None
                if t == "s" and text is not None:
                    out.append((shared[int(text)], "s"))
                elif t == "inlineStr":
                    out.append(("".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t")), "s"))
                elif t == "e" or (text is None and c.find("m:f", _NS) is not None):
                    out.append((text, "e"))
                elif t == "str":
                    out.append((text, "s"))
                else:
                    out.append((text, "d" if t == "n" and int(c.get("s", 0)) in dates else "n"))
            yield out
            row.clear()


def read(spark: SparkSession, path: str, member: str | None = None, guess: int = GUESS) -> Table:
    """A sheet (the first unless named) as a table."""
    load = spark.read.format("binaryFile").load(path).select("content")

    def of(batches):
        kind = pa.list_(pa.struct([("v", pa.string()), ("k", pa.string())]))
        for b in batches:
            for raw in b["content"].to_pylist():
                part, start = [], -1
                for r in rows(raw, member):
                    part.append([{"v": v, "k": k} for v, k in r])
                    if len(part) == 5000:
                        yield pa.record_batch({ROW: pa.array(range(start, start + 5000), pa.int64()), "c": pa.array(part, kind)})
                        start, part = start + 5000, []
                yield pa.record_batch({ROW: pa.array(range(start, start + len(part)), pa.int64()), "c": pa.array(part, kind)})

    cells = load.mapInArrow(of, f"{ROW} bigint, c array<struct<v:string,k:string>>")
    top = cells.where(F.col(ROW) == -1).first()
    run = []
    for c in top["c"] if top else []:  # the header is the run of cells that are not blank
        if not (c["v"] or "").strip():
            break
        run.append(c["v"])
    names, data, rules = header(run), cells.where(F.col(ROW) >= 0), RULES["xlsx"]
    cell = lambda i, f: F.get(F.col("c"), F.lit(i))[f]
    tests = []
    for i in range(len(names)):
        v, k = cell(i, "v"), cell(i, "k")
        number = k.isin("n", "d") & v.isNotNull()
        tests += [F.coalesce(F.bool_and(v.isNull() | number | (k == "e") | (F.trim(v) == "")), F.lit(False)).alias(f"f{i}"), F.coalesce(F.bool_or(number), F.lit(False)).alias(f"n{i}"), F.coalesce(F.bool_and(~number | (k == "d")), F.lit(False)).alias(f"d{i}")]
    seen = data.where(F.col(ROW) < guess).agg(*tests).first() if names else None
    out = [F.col(ROW)]
    for i, n in enumerate(names):
        v, k = cell(i, "v"), cell(i, "k")
        if seen[f"f{i}"] and seen[f"n{i}"]:
            value, code = text_number_cells(F.when(k != "e", v), rules)
            value = excel_seconds(value) if seen[f"d{i}"] else value
            meta = {"displayFormat": "E8601DT."} if seen[f"d{i}"] else {}
            out += [F.when(F.coalesce(k, F.lit("s")) != "e", value).alias(n, metadata=meta), F.when(k == "e", MIS_ERROR).otherwise(code).cast("tinyint").alias(mis(n))]
        else:
            out += [F.when(F.coalesce(k, F.lit("s")) != "e", text_cell(v, rules)).alias(n), F.when(k == "e", MIS_ERROR).cast("tinyint").alias(mis(n))]
    return Table(data.select(*out), member or "")


def library(spark: SparkSession, path: str) -> list[str]:
    """Names of a workbook's sheets."""
    return list(sheets(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])))
