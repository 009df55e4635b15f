"""Key identity: tags by which cells are equal exactly when they are one key.

Text, numbers, whole numbers beyond 2**53, empty text and each missing marker are disjoint.  LONG 2 and DOUBLE 2.0 are
one key, 2**53 and 2**53 + 1 are not.  A tag is never NULL, so that plain equality joins, groups and broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model.table import Table
from .values import clean_text, is_blank, strip

#: How keys with missing components are treated.
KEEP, DROP, COALESCE_COMPONENT = "keep", "drop", "coalesce"


def tag(table: Table, name: str) -> Column:
    c, kind = table.col(name), table.kind(name)
    missing = F.concat(F.lit("M:"), table.code(name).cast("string"))
    if kind == "STRING":
        held = F.when(c == "", "E:").otherwise(F.concat(F.lit("T:"), c))
    elif kind == "BOOLEAN":
        held = F.concat(F.lit("N:"), c.cast("int").cast("double").cast("string"))
    elif kind == "LONG":
        exact = F.abs(c) <= F.lit(9007199254740992)
        held = F.when(exact, F.concat(F.lit("N:"), c.cast("double").cast("string"))).otherwise(F.concat(F.lit("L:"), c.cast("string")))
    elif kind == "DOUBLE":
        v = c.cast("double") + F.lit(0.0)
        large = (F.abs(v) > 9007199254740992.0) & (F.abs(v) < 9.223372036854775e18) & (v == F.rint(v))
        held = F.when(large, F.concat(F.lit("L:"), v.cast("bigint").cast("string"))).otherwise(F.concat(F.lit("N:"), v.cast("string")))
    else:
        held = F.concat(F.lit("T:"), c.cast("string"))
    return F.when(c.isNull(), missing).otherwise(held)


def text_tag(table: Table, name: str) -> Column:
    """As ``tag``, numbers as their clean text: '1' and 1 are one key."""
    c, kind = table.col(name), table.kind(name)
    if kind in ("LONG", "DOUBLE"):
        text = c.cast("string") if kind == "LONG" else clean_text(c)
        return F.when(c.isNull(), F.concat(F.lit("M:"), table.code(name).cast("string"))).otherwise(F.concat(F.lit("T:"), text))
    return tag(table, name)


def blank(table: Table, name: str) -> Column:
    """Missing or empty: what a join that does not keep missings leaves out."""
    c = table.col(name)
    return c.isNull() | (c == "") if table.kind(name) == "STRING" else c.isNull()


def coalesced(table: Table, names: list[str]) -> Column:
    """A component made of the first column that is not blank, as a tag; 'E:' if all are."""
    picks = [F.when(~is_blank(table.col(n), table.kind(n)), F.concat(F.lit("T:"), strip(table.col(n))) if table.kind(n) == "STRING" else tag(table, n)) for n in names]
    return F.coalesce(*picks, F.lit("E:"))


def key(table: Table, names: list[str], as_text: bool = False) -> Column:
    """The composite key: the tag of one component, the struct of several."""
    tags = [(text_tag if as_text else tag)(table, n) for n in names]
    return tags[0] if len(tags) == 1 else F.struct(*[t.alias(f"k{i}") for i, t in enumerate(tags)])


def comparable(table: Table, name: str) -> list[Column]:
    """Sort keys of a column: missing first, by code, then values (cleaned numbers, text)."""
    c, kind = table.col(name), table.kind(name)
    from .values import clean_double

    value = clean_double(c) if kind == "DOUBLE" else c
    return [c.isNotNull().asc(), table.code(name).asc(), value.asc()]
