"""One projection per format: what its nothing and its nonsense become in a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import DAYS, SECONDS
from ..functions.values import list_cell, right_trim, sentinel_code, strip
from ..model.missing import MIS, MIS_ERROR, MIS_UNKNOWN
from ..model.table import mis, quoted


@dataclass(frozen=True)
class Rules:
    """How a source's cells are read.  Codes: of an absent number, blank text, NaN, an infinity, and unparsable text."""

    absent_text: str | None
    absent: int = MIS
    blank: int = MIS
    nan: int = MIS
    infinite: int = MIS_ERROR
    unparsable: int = MIS_ERROR


#: The rules of each format.
RULES = {
    "csv": Rules(""),
    "parquet": Rules(None),
    "dsj": Rules(None, nan=MIS_ERROR),
    "xpt": Rules("", absent=MIS_UNKNOWN),
    "sas7bdat": Rules("", absent=MIS_UNKNOWN),
    "xlsx": Rules(""),
    "cdt": Rules(""),
}


def text_cell(c, rules: Rules):
    return right_trim(c) if rules.absent_text is None else F.coalesce(right_trim(c), F.lit(rules.absent_text))


def number_cells(c, rules: Rules):
    """(value, code) of a double column."""
    infinite = F.abs(c) == float("inf")
    code = F.when(c.isNull(), rules.absent).when(F.isnan(c), rules.nan).when(infinite, rules.infinite)
    return F.when(code.isNull(), c + F.lit(0.0)), code.cast("tinyint")


def text_number_cells(c, rules: Rules, quoted_flag=None):
    """(value, code) of text that should be a number; dot-family markers count unless quoted."""
    s = strip(c)
    v = s.try_cast("double")
    flag = F.coalesce(quoted_flag, F.lit(False)) if quoted_flag is not None else F.lit(False)
    code = (
        F.when(c.isNull(), rules.absent).when(~flag & sentinel_code(s).isNotNull(), sentinel_code(s)).when(s == "", F.when(flag, MIS_ERROR).otherwise(rules.blank))
        .when(v.isNull(), rules.unparsable).when(F.isnan(v), rules.nan).when(F.abs(v) == float("inf"), rules.infinite)
    )
    return F.when(code.isNull(), v + F.lit(0.0)), code.cast("tinyint")


def parquet(df: DataFrame) -> DataFrame:
    """Logical types of Parquet: dates and times from 1960, decimals as exact doubles, unsigned and nested types."""
    rules, out = RULES["parquet"], []
    for f in df.schema.fields:
        c, meta = F.col(quoted(f.name)), f.metadata
        t = f.dataType
        if isinstance(t, T.StringType):
            out.append(text_cell(c, rules).alias(f.name, metadata=meta))
            continue
        if isinstance(t, T.DateType):
            v = (F.unix_date(c) + DAYS).cast("double")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            v = F.unix_micros(c.cast("timestamp")) / 1e6 + SECONDS
        elif isinstance(t, T.DecimalType):
            v = c.cast("double")
            lossy = v.cast(t).eqNullSafe(c) | c.isNull()
            v = F.when(lossy, v).otherwise(F.raise_error(F.concat(F.lit(f"{f.name}: a decimal is not exact as a double: "), c.cast("string"))).cast("double"))
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            value, code = number_cells(c.cast("double") if isinstance(t, T.DoubleType) else c.cast("string").cast("double"), rules)
            out += [value.alias(f.name, metadata=meta), code.alias(mis(f.name))]
            continue
        elif isinstance(t, T.IntegralType):
            v = c.cast("bigint")
        elif isinstance(t, T.BooleanType):
            v = c
        elif isinstance(t, T.NullType):
            v = c.cast("string")
        elif isinstance(t, T.ArrayType):
            v = list_cell(c)
        else:
            v = F.to_json(c) if isinstance(t, (T.StructType, T.MapType)) else c.cast("string")
        out.append(v.alias(f.name, metadata=meta))
    return df.select(*out)
