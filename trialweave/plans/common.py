"""Reading the driver's tables with a row identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.table import ROW, Table
from ..sources.catalog import in_place

#: Unique columns of the driver's tables; rows are identified by them.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"]}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> Table:
    """A table whose row identity is its whole-number key: no numbering pass, no shuffle."""
    df = read(spark, sf_dir, name)
    row = F.col("l_orderkey") * 100 + F.col("l_linenumber") if name == "lineitem" else F.col(KEYS[name][0])
    df = df.withColumn(ROW, row.cast("bigint"))
    return Table(df.select(*columns, ROW) if columns else df, name.upper())


def placed(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> Table:
    """A table whose row identity is its rows' place in the files, for tables without a unique key."""
    df = in_place(read(spark, sf_dir, name).select(*columns))
    return Table(df.withColumnRenamed("__at", ROW), name.upper())
