"""Lines of text files, numbered over splits and files without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model.table import ROW

#: Splits up to which their offsets are broadcast: one short row each.
MAX_BROADCAST_ROWS = 1_000_000


def numbered(rows: DataFrame, sizes: DataFrame | None = None, header: bool = True) -> DataFrame:
    """Rows (file, block, place, ...) with ``__row``, from 0 over all files, and ``head``: the first of a file.

    With ``header`` a file's first row is not counted.

    ``sizes``: (file, block, n, least) of each split, if they are known; there is one row for each, so that one task
    can add them up.
    """
    if sizes is None:
        sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    heads = F.when(F.col("block") == 0, int(header)).otherwise(0)
    offsets = sizes.select(F.xxhash64("file").alias("f"), F.col("block").alias("b"), "least", (F.coalesce(F.sum(F.col("n") - heads).over(before), F.lit(0)) - heads).alias("offset"))
    if offsets.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    met = rows.join(offsets, (F.xxhash64("file") == F.col("f")) & (F.col("block") == F.col("b")))
    head = (F.col("block") == 0) & (F.col("place") == F.col("least"))
    return met.withColumns({ROW: F.col("offset") + F.col("place") - F.col("least"), "head": head}).drop("f", "b", "least", "offset")


def split_lines(spark: SparkSession, path: str, quote: str = "", header: bool = True) -> tuple[DataFrame, bool]:
    """((``__row``, line, file, head) of every line, whether some line holds an odd number of quotes)."""
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    odd = (F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))) % 2 == 1 if quote else F.lit(False)
    sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"), F.coalesce(F.bool_or(odd), F.lit(False)).alias("odd"))
    if quote and not sizes.where("odd").isEmpty():
        return rows, True
    return numbered(rows, sizes.drop("odd"), header), False
