"""Dataset-JSON 1.1: ``.json`` (one document), ``.ndjson`` (metadata line, then one array a line) and zlib containers.

NDJSON is split over tasks by lines and parsed by Spark; documents and containers are one task a file.
"""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model.table import ROW, Table, encoding_meta, mis
from .lines import split_lines
from .normalise import RULES, text_cell, text_number_cells

#: Data types that are numbers.
_NUMBERS = {"integer", "decimal", "float", "double"}


class RowCountMismatch(ValueError):
    """The file declares another number of records than it holds."""


def kind(column: dict) -> str:
    """DOUBLE for numbers (also as target type), BOOLEAN, else STRING."""
    if column.get("targetDataType") in ("integer", "decimal") or column.get("dataType") in _NUMBERS:
        return "DOUBLE"
    return "BOOLEAN" if column.get("dataType") == "boolean" else "STRING"


def _cell(v):
    return None if v is None else (v if isinstance(v, str) else json.dumps(v))


def _documents(path: str, compressed: bool):
    """(__row, cells) of whole documents; row -1 holds the metadata."""

    def of(batches):
        for b in batches:
            for raw in b["content"].to_pylist():
                text = (zlib.decompress(raw) if compressed else raw).decode()
                if compressed:
                    first, *rest = text.splitlines()
                    head, rows = json.loads(first), (json.loads(x) for x in rest if x.strip())
                else:
                    head = json.loads(text)
                    rows = iter(head.pop("rows", []))
                yield pa.record_batch({ROW: pa.array([-1], pa.int64()), "c": pa.array([[json.dumps(head)]], pa.list_(pa.string()))})
                part, start = [], 0
                for r in rows:
                    part.append([_cell(v) for v in r])
                    if len(part) == 5000:
                        yield pa.record_batch({ROW: pa.array(range(start, start + 5000), pa.int64()), "c": pa.array(part, pa.list_(pa.string()))})
                        start, part = start + 5000, []
                yield pa.record_batch({ROW: pa.array(range(start, start + len(part)), pa.int64()), "c": pa.array(part, pa.list_(pa.string()))})

    return of


def _lines(spark: SparkSession, path: str):
    """The same of NDJSON, one file or a folder of parts: lines that open an object are metadata, arrays are records."""
    rows, _ = split_lines(spark, path, header=False)
    record = F.ltrim("line").startswith("[")
    head = rows.where(~record & (F.trim("line") != "")).select(F.lit(-1).cast("bigint").alias(ROW), F.array("line").alias("c"), "file", F.col(ROW).alias("at"))
    first = head.orderBy("file", "at").limit(1).select(ROW, "c")
    return rows.where(record).select((F.col(ROW) - 1).alias(ROW), F.from_json("line", "array<string>").alias("c")).unionByName(first)


def read(spark: SparkSession, path: str, name: str = "", check: bool = True) -> Table:
    """A Dataset-JSON file as a table.  A null cell is missing, an empty text is ''."""
    if path.lower().endswith(".ndjson"):
        rows = _lines(spark, path)
    else:
        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_documents(path, path.lower().endswith(".dsjc")), f"{ROW} bigint, c array<string>")
    head = json.loads(rows.where(F.col(ROW) == -1).first()["c"][0])
    data = rows.where(F.col(ROW) >= 0)
    if check and "records" in head and (n := data.count()) != head["records"]:
        raise RowCountMismatch(f"{path}: {head['records']} records declared, {n} found")
    out, rules = [F.col(ROW)], RULES["dsj"]
    for i, column in enumerate(head.get("columns", [])):
        v, k = F.get(F.col("c"), F.lit(i)), kind(column)
        meta = {a: column[a] for a in ("label", "length", "displayFormat", "keySequence") if a in column}
        if k == "DOUBLE":
            value, code = text_number_cells(F.regexp_replace(v, r"(?<=\d),(?=\d{3})", ""), rules)
            out += [value.alias(column["name"], metadata=meta), code.alias(mis(column["name"]))]
        elif k == "BOOLEAN":
            out += [F.when(v == "true", True).when(v == "false", False).alias(column["name"], metadata=meta), F.when(v.isNotNull() & ~v.isin("true", "false"), 102).cast("tinyint").alias(mis(column["name"]))]
        else:
            out.append(text_cell(v, rules).alias(column["name"], metadata=meta))
    return Table(data.select(*out), name or head.get("name", ""), head.get("label", ""), {"records": head.get("records"), **encoding_meta("UTF-8", "FORMAT")})
