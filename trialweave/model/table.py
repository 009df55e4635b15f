"""A table: a DataFrame, its row identity, companion columns of missing codes, and metadata.

A logical column ``C`` is a physical column ``C`` (NULL when missing) and, where a cell's marker is not the plain
one, a companion ``C__mis`` (tinyint) that holds the marker's code.  Text: NULL is missing, '' is empty.  ``__row``
(bigint) is the row's identity; it survives every operator.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..shared import shared_dir

ROW = "__row"
HIDDEN = "__"
#: Bits of Spark's increasing ids that count within a task; those above are the task.
_IN_TASK = 33
#: Where a table's encoding is from, the least certain first.
ENCODING_SOURCES = ("DEFAULT", "CONFIGURED", "FORMAT", "DECLARED")


def encoding_meta(encoding: str, source: str) -> dict:
    return {"Encoding": encoding, "EncodingSource": source}


def agreed_encoding(metas: list[dict]) -> dict:
    """Of several tables: their one encoding or MIXED, from the least certain source; nothing if one has none."""
    if not metas or any("Encoding" not in m for m in metas):
        return {}
    names = {m["Encoding"] for m in metas}
    return encoding_meta(names.pop() if len(names) == 1 else "MIXED", min((m["EncodingSource"] for m in metas), key=ENCODING_SOURCES.index))


def mis(name: str) -> str:
    """Name of a column's companion."""
    return f"{name}__mis"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kind_of(t: T.DataType) -> str:
    """The logical type: STRING, LONG, DOUBLE, BOOLEAN or OTHER."""
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(t, T.IntegralType):
        return "LONG"
    return "OTHER"


@dataclass(frozen=True)
class Table:
    df: DataFrame
    name: str = ""
    label: str = ""
    meta: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, name: str = "", order: list[str] | None = None, **kw) -> Table:
        """Wrap a DataFrame; ``__row`` is numbered from 0 by ``order`` (or by position, if there is none yet)."""
        if ROW not in df.columns:
            df = number_rows(df, order)
        return cls(df, name, **kw)

    @property
    def columns(self) -> list[str]:
        """Visible columns, without row identity, companions and flags of supply."""
        return [c for c in self.df.columns if not c.startswith(HIDDEN) and not c.endswith("__mis")]

    def find(self, name: str) -> str | None:
        """A column by its name, case-insensitively; None if there is none."""
        return next((c for c in self.columns if c.lower() == name.lower()), None)

    def require(self, name: str) -> str:
        if (found := self.find(name)) is None:
            raise KeyError(f"{self.name or 'table'} has no column {name}")
        return found

    def kind(self, name: str) -> str:
        return kind_of(self.df.schema[self.require(name)].dataType)

    def col(self, name: str) -> Column:
        return self.df[quoted(self.require(name))]

    def code(self, name: str) -> Column:
        """The marker's code of a cell, NULL where it is not missing."""
        c = self.require(name)
        value = self.df[quoted(c)]
        held = self.df[quoted(mis(c))].cast("int") if mis(c) in self.df.columns else F.lit(None).cast("int")
        return F.when(value.isNull(), F.coalesce(held, F.lit(64)))

    def with_df(self, df: DataFrame, **kw) -> Table:
        return replace(self, df=df, **kw)

    def labels(self) -> dict[str, str]:
        return {c: self.df.schema[c].metadata.get("label", "") for c in self.columns}

    def show_columns(self) -> DataFrame:
        """The visible columns in row order of their names."""
        return self.df.select(*[F.col(quoted(c)) for c in self.columns])


def number_rows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0: by columns through a range shuffle, or by their place in the input.

    The rows are made once, and written to the shared folder with their task and their place in it; no single task sees
    all of them: they are counted by task and numbered from the tasks' offsets.
    """
    if order:
        df = df.orderBy(*order)
    spark, fields = df.sparkSession, df.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    kept = [n for n, f in zip(names, fields, strict=True) if not isinstance(f.dataType, T.NullType)]  # Parquet has no type for these
    made = df.toDF(*names).select(*kept, F.monotonically_increasing_id().alias("at"))
    path = f"{shared_dir(spark)}/numbered/{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(made.schema).parquet(path).withColumns({"task": F.shiftright("at", _IN_TASK), "place": F.col("at").bitwiseAND(F.lit((1 << _IN_TASK) - 1))})
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    sizes = rows.groupBy(F.col("task").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    met = rows.join(F.broadcast(offsets), F.col("task") == F.col("of"))
    cells = [(F.col(n) if n in kept else F.lit(None)).alias(f.name, metadata=f.metadata) for n, f in zip(names, fields, strict=True)]
    return met.select(*cells, (F.col("offset") + F.col("place")).alias(ROW))
