"""Projections, row maps, slices, zips, unions, overlays, equality, column content and group blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import key, tag
from ..model.table import ROW, Table, agreed_encoding, kind_of, mis, number_rows, quoted

#: Spark types of the logical types, for columns that a union has to fill.
_SPARK = {"STRING": "string", "LONG": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "OTHER": "string"}


#: Of a row map's rows: the row of the table that they show.
BASE_ROW = "__base_row"


class TypeClash(ValueError):
    """Columns of one name have different types and neither is blank."""


def project(t: Table, names: list[str | None], optional: bool = False) -> Table:
    """Columns by name, in any order; None is a column without backing (text '', named V<n>).

    Unknown names raise, or are left out if ``optional``.
    """
    out: list[Column] = [F.col(ROW)]
    seen: dict[str, int] = {}
    for i, name in enumerate(names):
        if name is None:
            out.append(F.lit("").alias(f"V{i + 1}"))
            continue
        found = t.find(name)
        if found is None:
            if optional:
                continue
            t.require(name)
        seen[found] = seen.get(found, 0) + 1
        alias = found if seen[found] == 1 else f"{found}_{seen[found]}"
        out.append(F.col(quoted(found)).alias(alias))
        if mis(found) in t.df.columns:
            out.append(F.col(quoted(mis(found))).alias(mis(alias)))
    return t.with_df(t.df.select(*out))


def row_map(t: Table, view: DataFrame, missing: int = 64) -> Table:
    """Rows by a map (out_row, base_row): filter, sort, sample or expand.  base_row -1: a row of defaults.

    Text cells of such rows are '', others missing with the given code.  ``__base_row`` tells the row that a row shows;
    through several maps it goes back to the first table's.
    """
    base = t.df.withColumnRenamed(ROW, "base_row")
    joined = view.join(base, "base_row", "left")
    first = F.col(BASE_ROW) if BASE_ROW in t.df.columns else F.col("base_row")
    out = [F.col("out_row").alias(ROW), F.when(F.col("base_row") == -1, F.lit(-1)).otherwise(first).cast("bigint").alias(BASE_ROW)]
    gone = F.col("base_row") == -1
    for c in t.columns:
        v = F.col(quoted(c))
        out.append((F.when(gone, F.lit("")).otherwise(v) if t.kind(c) == "STRING" else v).alias(c))
        if t.kind(c) != "STRING" and (mis(c) in t.df.columns or missing != 64):
            held = F.col(quoted(mis(c))) if mis(c) in t.df.columns else F.lit(None)
            out.append(F.when(gone, F.lit(missing)).otherwise(held).cast("tinyint").alias(mis(c)))
    return t.with_df(joined.select(*out))


def row_slice(t: Table, start: int, end: int = -1) -> Table:
    """Rows start to end (exclusive); end -1: to the last."""
    df = t.df.where(F.col(ROW) >= start)
    return t.with_df(df if end < 0 else df.where(F.col(ROW) < end))


def zip_tables(*tables: Table, name: str = "", check: bool = True) -> Table:
    """Columns of tables of equal length side by side, by row position; names must differ.

    Unequal lengths are refused: one count of each table's rows, which ``check=False`` leaves out.
    """
    seen: set[str] = set()
    for t in tables:
        clash = seen & {c.lower() for c in t.columns}
        if clash:
            raise ValueError(f"columns occur twice: {sorted(clash)}")
        seen |= {c.lower() for c in t.columns}
    if check and len(lengths := [t.df.count() for t in tables]) and len(set(lengths)) > 1:
        raise ValueError(f"tables of unequal length: {lengths}")
    out = None
    for t in tables:
        df = t.df
        for c in t.columns:
            df = df.withMetadata(c, {**df.schema[c].metadata, "merged_from": t.name})
        out = df if out is None else out.join(df, ROW)
    return Table(out, name)


def content(t: Table, names: list[str] | None = None) -> DataFrame:
    """(column, status, uniform) of columns in one pass: FILLED, EMPTY or MISSING; uniform: one value at most.

    FILLED: some cell holds a value; EMPTY: none does but some text cell is ''; MISSING otherwise (no rows: MISSING).
    """
    names = names or t.columns
    aggs = []
    for c in names:
        v, text = t.col(c), t.kind(c) == "STRING"
        filled = (v.isNotNull() & (v != "")) if text else v.isNotNull()
        empty = (v == "") if text else F.lit(False)
        aggs.append(F.struct(F.coalesce(F.bool_or(filled), F.lit(False)).alias("f"), F.coalesce(F.bool_or(F.coalesce(empty, F.lit(False))), F.lit(False)).alias("e"), F.coalesce(F.min(tag(t, c)) == F.max(tag(t, c)), F.lit(True)).alias("u")).alias(c))
    one = t.df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(quoted(c))["f"], "FILLED").when(F.col(quoted(c))["e"], "EMPTY").otherwise("MISSING").alias("status"), F.col(quoted(c))["u"].alias("uniform")) for c in names])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def blank_columns(t: Table, names: list[str]) -> set[str]:
    """Those of the columns that hold nothing, in one pass."""
    names = [t.require(n) for n in names]
    return {r["column"] for r in content(t, names).collect() if r["status"] != "FILLED"} if names else set()


def is_blank_column(t: Table, name: str) -> bool:
    return bool(blank_columns(t, [name]))


def max_bytes(t: Table) -> DataFrame:
    """Largest UTF-8 length of each text column, one row."""
    return t.df.agg(*[F.coalesce(F.max(F.octet_length(F.col(quoted(c)))), F.lit(0)).alias(c) for c in t.columns if t.kind(c) == "STRING"])


def union(*tables: Table, name: str = "") -> Table:
    """All rows by column name, first-seen order; rows are numbered on over the members.

    Where a member lacks a column its text cells are '' and others missing.  Types must agree, but a member whose
    column is blank gives way; if all are blank, text wins.  ``__member`` and ``__member_row`` tell where a row is from.
    """
    order: dict[str, str] = {}
    for t in tables:
        for c in t.columns:
            order.setdefault(c.lower(), c)
    kinds_of = {low: {t.kind(c) for t in tables if (c := t.find(low))} for low in order}
    asked = [low for low in order if len(kinds_of[low]) > 1]
    blank = [blank_columns(t, [c for low in asked if (c := t.find(low))]) for t in tables]  # one pass a member
    target: dict[str, str] = {}
    for low in order:
        kinds = kinds_of[low]
        if len(kinds) > 1:
            filled = {t.kind(c) for t, b in zip(tables, blank, strict=True) if (c := t.find(low)) and c not in b}
            if len(filled) > 1:
                raise TypeClash(f"column {order[low]}: {sorted(filled)}")
            kinds = filled or ({"STRING"} if "STRING" in kinds else {sorted(kinds)[0]})
        target[low] = next(iter(kinds))
    out, offset = None, 0
    for i, t in enumerate(tables):
        cols = [(F.col(ROW) + offset).alias(ROW), F.lit(i).alias("__member"), F.col(ROW).alias("__member_row")]
        for low, c in order.items():
            found, kind = t.find(low), target[low]
            if found and t.kind(found) == kind:
                cols.append(F.col(quoted(found)).cast(_SPARK[kind]).alias(c))
            elif found:  # blank in this member
                cols.append(F.lit("" if kind == "STRING" else None).cast(_SPARK[kind]).alias(c))
            else:
                cols.append(F.lit("" if kind == "STRING" else None).cast(_SPARK[kind]).alias(c))
            if any(mis(x.find(low) or "") in x.df.columns for x in tables):
                own = found and mis(found) in t.df.columns
                cols.append((F.col(quoted(mis(found))) if own else F.lit(None)).cast("tinyint").alias(mis(c)))
        part = t.df.select(*cols)
        out = part if out is None else out.unionByName(part)
        if i + 1 < len(tables):
            offset += (t.df.agg(F.max(ROW)).first()[0] or 0) + 1
    return Table(out, name, meta=agreed_encoding([t.meta for t in tables]))


def overlay(t: Table, edits: DataFrame | None = None, column: str = "", rename: dict | None = None, drop: list[str] = (), add: dict | None = None, labels: dict | None = None, name: str | None = None) -> Table:
    """Edits over a table: cell values (edits: row, value; for one column), added, renamed, dropped and labelled columns."""
    df = t.df
    if edits is not None:
        c = t.require(column)
        delta = edits.select(F.col("row").alias(ROW), F.col("value").alias("__value"), F.lit(True).alias("__edited"))
        df = df.join(delta, ROW, "left").withColumn(c, F.when(F.col("__edited"), F.col("__value").cast(df.schema[c].dataType)).otherwise(F.col(quoted(c)))).drop("__value", "__edited")
    for c in drop:
        df = df.drop(t.require(c), mis(t.require(c)))
    for c, v in (add or {}).items():
        df = df.withColumn(c, v)
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(t.require(a), b).withColumnRenamed(mis(t.require(a)), mis(b))
    for c, label in (labels or {}).items():
        df = df.withMetadata(c, {**df.schema[c].metadata, "label": label})
    return t.with_df(df, **({} if name is None else {"name": name}))


def equal(a: Table, b: Table) -> bool:
    """Same columns, and the same cells (values and markers) row by row."""
    if [c.lower() for c in a.columns] != [c.lower() for c in b.columns]:
        return False
    side = lambda t: t.df.select(ROW, *[tag(t, c).alias(f"c{i}") for i, c in enumerate(t.columns)])
    x, y = side(a), side(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def group_blocks(t: Table, names: list[str]) -> DataFrame:
    """One row per group: block (by first appearance), first_row, n.  Blocks are numbered over groups, not rows."""
    tags = [tag(t, n).alias(f"k{i}") for i, n in enumerate(names)]
    groups = t.df.select(ROW, *tags).groupBy(*[f"k{i}" for i in range(len(names))]).agg(F.min(ROW).alias("first_row"), F.count(F.lit(1)).alias("n"))
    return number_rows(groups, ["first_row"]).withColumnRenamed(ROW, "block")


def with_group(t: Table, names: list[str], to: str = "__first") -> DataFrame:
    """The rows with the first row of their group (its identity), without numbering blocks."""
    w = Window.partitionBy(*[tag(t, n) for n in names])
    return t.df.withColumn(to, F.min(ROW).over(w))


def distinct_in_order(t: Table, name: str) -> DataFrame:
    """Distinct values of a column with the row of their first appearance."""
    return t.df.groupBy(t.col(name).alias(name)).agg(F.min(ROW).alias("first_row"))


__all__ = ["TypeClash", "blank_columns", "content", "distinct_in_order", "equal", "group_blocks", "is_blank_column", "key", "kind_of", "max_bytes", "overlay", "project", "row_map", "row_slice", "union", "with_group", "zip_tables"]
