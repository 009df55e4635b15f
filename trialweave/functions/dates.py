"""Dates and times counted from 1960-01-01, and display formats."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From 1960-01-01 to the Unix epoch.
DAYS, SECONDS = 3653, 315619200


def days(c: Column) -> Column:
    return (F.unix_date(c.cast("date")) + DAYS).cast("double")


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6 + SECONDS


def time_seconds(text: Column) -> Column:
    """Seconds of an ISO time hh:mm[:ss[.fff]]."""
    part = lambda i: F.coalesce(F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?$", i).try_cast("double"), F.lit(0.0))
    return F.when(text.rlike(r"^\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?$"), part(1) * 3600 + part(2) * 60 + part(3))


def date_of(c: Column) -> Column:
    return F.date_add(F.lit("1960-01-01").cast("date"), F.floor(c).cast("int"))


def datetime_of(c: Column) -> Column:
    return F.timestamp_micros(((c - SECONDS) * 1e6).cast("bigint"))


def date_text(c: Column) -> Column:
    return F.date_format(date_of(c), "yyyy-MM-dd")


def datetime_text(c: Column) -> Column:
    return F.date_format(datetime_of(c), "yyyy-MM-dd'T'HH:mm:ss")


def time_text(c: Column) -> Column:
    s = F.floor(c).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def excel_seconds(serial: Column) -> Column:
    """Spreadsheet serial day to seconds from 1960; beyond 9999-12-31 there is no date."""
    return F.when((serial >= 0) & (serial < 2958466), (serial - 21916) * 86400.0)


#: Display formats of dates, datetimes and times (names without width), and of the Unix origin.
DATE_FORMATS = frozenset("DATE DAY DDMMYY DOWNAME E8601DA B8601DA IS8601DA JULDAY JULIAN MMDDYY MMYY MONNAME MONTH MONYY NENGO QTR QTRR WEEKDATE WEEKDATX WEEKDAY WORDDATE WORDDATX YEAR YYMM YYMMDD YYMON YYQ YYQR YYQZ".split())
DATETIME_FORMATS = frozenset("DATETIME DATEAMPM DTDATE DTMONYY DTWKDATX DTYEAR DTYYQC E8601DT B8601DT IS8601DT E8601DZ B8601DZ E8601DN B8601DN MDYAMPM".split())
TIME_FORMATS = frozenset("TIME TIMEAMPM HHMM HOUR MMSS TOD E8601TM B8601TM IS8601TM E8601TZ B8601TZ E8601LZ B8601LZ".split())


@dataclass(frozen=True)
class Format:
    name: str
    width: int | None
    decimals: int | None

    @property
    def character(self) -> bool:
        return self.name.startswith("$")


_FORMAT = re.compile(r"^(\$?[A-Za-z_]?[A-Za-z0-9_]*?)(\d+)?(?:\.(\d*))?$")


def parse_format(text: str) -> Format | None:
    """NAMEw.d"""
    m = _FORMAT.match(text.strip())
    return Format(m[1].upper(), int(m[2]) if m[2] else None, int(m[3]) if m[3] else None) if m and text.strip() else None


def format_category(text: str) -> str:
    f = parse_format(text)
    name = f.name if f else ""
    for known, category in ((DATETIME_FORMATS, "DATETIME_SAS"), (DATE_FORMATS, "DATE_SAS"), (TIME_FORMATS, "TIME_SAS")):
        if name in known or text.strip().rstrip(".0123456789").upper() in known or re.sub(r"\d*\.?\d*$", "", text.strip().upper()) in known:
            return category
    return "OTHER"


def category_column(c: Column) -> Column:
    """The category of a column of format texts."""
    name = F.regexp_replace(F.upper(F.trim(c)), r"\d*\.?\d*$", "")
    return F.when(name.isin(*sorted(DATETIME_FORMATS)), "DATETIME_SAS").when(name.isin(*sorted(DATE_FORMATS)), "DATE_SAS").when(name.isin(*sorted(TIME_FORMATS)), "TIME_SAS").otherwise("OTHER")
