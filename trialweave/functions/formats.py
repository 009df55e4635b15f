"""Names of formats: those of code lists, and times that do not wrap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest name of a format, its $ included.
MAX_LENGTH = 32
#: Time formats of durations and clock times that are not taken modulo a day.
UNWRAPPED = (
    "TIME", "MMSS", "HHMM", "HOUR", "B8601LZ", "B8601TM", "B8601TX", "B8601TZ", "E8601LZ", "E8601TM", "E8601TX", "E8601TZ",
    "IS8601LZ", "IS8601TM", "IS8601TZ", "JTIMEH", "JTIMEHM", "JTIMEHMS", "JTIMEHW", "JTIMEMW", "JTIMESW",
)


def is_unwrapped_time(fmt: Column) -> Column:
    """A time format whose values of a day or more, or below zero, are not brought into one day."""
    plain = F.upper(F.trim(fmt))
    known = plain.isin(*UNWRAPPED) | F.regexp_replace(plain, r"\d*\.\d*$", "").isin(*UNWRAPPED) | F.regexp_replace(plain, r"\d+\.?\d*$", "").isin(*UNWRAPPED)
    return F.coalesce(known, F.lit(False))


def codelist_format(name: Column, text: Column) -> Column:
    """The format name of a code list: ``$`` in front of a text one's, once."""
    return F.when(text & ~name.startswith("$"), F.concat(F.lit("$"), name)).otherwise(name)


def usable_format(name: Column, text: Column) -> Column:
    """A name that can be a format's: a letter or _ first, at most 32 long, and with a ``$`` exactly for text."""
    fits = (F.length(name) <= MAX_LENGTH) & (name.startswith("$") == text) & name.rlike(r"^\$?[A-Za-z_][A-Za-z_0-9]*$")
    return F.coalesce(fits, F.lit(False))


def codelist_alias(name: Column, sas_name: Column, text: Column) -> Column:
    """The further name of a code list's format: a usable one that is not its own but for case; else NULL."""
    return F.when(usable_format(sas_name, text) & (F.upper(sas_name) != F.upper(codelist_format(name, text))), sas_name)


def spelled(name: Column, width: Column, decimals: Column, number: Column) -> Column:
    """The spelling of a stored format: NAMEw.d, for text NAMEw., a bare w.d of numbers; NULL where there is no format.

    A name that holds the whole spelling already, with neither width nor decimals beside it, stays as it is.
    """
    n = F.coalesce(F.trim(name), F.lit(""))
    w = F.when(width > 0, width.cast("string")).otherwise("")
    d = F.when(number & (decimals > 0), decimals.cast("string")).otherwise("")
    whole = F.contains(n, F.lit(".")) & ~(width > 0) & ~(decimals > 0)
    return F.when((n == "") & (~number | ~(width > 0)), None).when(whole, n).otherwise(F.concat(n, w, F.lit("."), d))
