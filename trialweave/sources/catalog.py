"""Formats by file name, and reading by one call; folders as libraries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model.table import ROW, Table
from . import cdt, dataset_json, delimited, normalise, sas7bdat, spreadsheet, transport

#: Format of a file name, first match first.
FORMATS = ((r"\.csv$|\.tsv$|\.txt$", "csv"), (r"\.parquet$", "parquet"), (r"\.ndjson$|\.dsjc$|\.json$", "dsj"), (r"\.xpt$", "xpt"), (r"\.cdt$", "cdt"), (r"\.xlsx$", "xlsx"), (r"\.sas7bdat$", "sas7bdat"))


#: Files up to which their offsets are broadcast: one short row each.
MAX_BROADCAST_ROWS = 1_000_000


def format_of(path: str) -> str | None:
    return next((f for p, f in FORMATS if re.search(p, path.split("#")[0], re.I)), None)


def in_place(df: DataFrame) -> DataFrame:
    """A scan of Parquet with ``__at``, by file and by each row's place in it: no pass but the count of each file's rows."""
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    sizes = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = sizes.select(F.xxhash64("__file").alias("__f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    if offsets.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rows = placed.join(offsets, F.xxhash64("__file") == F.col("__f")).withColumn("__at", F.col("__offset") + F.col("__place"))
    return rows.drop("__file", "__place", "__f", "__offset")


def _parquet(spark: SparkSession, path: str, **options) -> Table:
    """Parquet, numbered in the order of its files and rows."""
    cells = normalise.parquet(in_place(spark.read.options(**options).parquet(path)))
    return Table(cells.withColumnRenamed("__at", ROW), path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0])


READERS = {"csv": delimited.read, "parquet": _parquet, "dsj": dataset_json.read, "xpt": transport.read, "cdt": cdt.read, "xlsx": spreadsheet.read, "sas7bdat": sas7bdat.read}


def read(spark: SparkSession, uri: str, **options) -> Table:
    """A table by its URI; a fragment names the member of a file of several."""
    path, _, member = uri.partition("#")
    found = format_of(path)
    if found is None:
        raise ValueError(f"no reader takes {uri}")
    return READERS[found](spark, path, **({"member": member} if member else {}), **options)


def describe(spark: SparkSession, uri: str, **options) -> tuple[list[dict], int]:
    """(columns: name, kind, label, displayFormat; rows) of a table, without its cells where the format says so itself."""
    path, _, member = uri.partition("#")
    found = format_of(path)
    if found == "sas7bdat":
        meta = sas7bdat.described(spark, path)
        return [{"name": c["name"], "kind": "DOUBLE" if c["number"] else "STRING", "label": c["label"], "displayFormat": c["displayFormat"]} for c in meta["columns"]], meta["rows"]
    if found == "parquet":
        df = spark.read.options(**options).parquet(path)
        t, rows = Table(normalise.parquet(df)), df.count()  # the footers know both
    else:
        t = read(spark, uri, **options)
        rows = t.meta.get("records") if t.meta.get("records") is not None else t.df.count()
    info = lambda c: t.df.schema[c].metadata
    return [{"name": c, "kind": t.kind(c), "label": info(c).get("label", ""), "displayFormat": info(c).get("displayFormat", "")} for c in t.columns], rows


def register(name: str, pattern: str, reader) -> None:
    """Add a format: its name, a pattern of file names, and a reader (spark, path, **options) -> Table."""
    global FORMATS
    FORMATS = ((pattern, name), *FORMATS)
    READERS[name] = reader


def folder(spark: SparkSession, path: str) -> dict[str, str]:
    """Members of a folder: name -> URI of every file that a reader takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path").orderBy("path").toLocalIterator()
    return {r["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]: r["path"] for r in files if format_of(r["path"])}
