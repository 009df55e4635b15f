"""Shared folder, staging and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let Python tasks get at most ``rows`` rows, and about ``size`` bytes, at a time: whole texts are long.

    The session keeps these settings; smaller ones of its own stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    ``by``: a column of few values that the files are parted by, so that readers of one value skip the others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{label}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, max_rows: int, items: Column | None = None, max_items: int = 2_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small, else unhinted (shuffle join).

    Small: at most ``max_rows`` rows, and where rows hold arrays, at most ``max_items`` of ``items`` in all.  ``df``
    should be a staged or otherwise cheap table: it is counted.
    """
    if items is None:
        return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(items), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_items else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(column: str = "text") -> Column:
    """64-bit content key; with doc_id it identifies a row up to exact repetition."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Null-safe equality on columns of the same names."""
    cond = left[columns[0]].eqNullSafe(right[columns[0]])
    for c in columns[1:]:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond
