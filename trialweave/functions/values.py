"""Numbers and text: cleaning, plain text, canonical keys, conversions, blankness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the JVM strips: white space without the no-break spaces.
_SPACE = r"\p{javaWhitespace}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def right_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"{_SPACE}+$", "")


def store_double(c: Column) -> Column:
    """As a column keeps it: no negative zero, NaN is missing."""
    return F.when(~F.isnan(c), c + F.lit(0.0))


def clean_double(c: Column) -> Column:
    """Without binary noise: half-even to 12 significant digits, if that changes the value by 1e-12 of its decade at most.

    Whole numbers, infinities and NaN stay; magnitudes under 1e-13 are 0.
    """
    v = c.cast("double")
    easy = F.isnan(v) | (v == F.rint(v))  # also infinities
    return F.when(easy, v + F.lit(0.0)).when(F.abs(v) < 1e-13, F.lit(0.0)).otherwise(let(v, _cleaned))


def _cleaned(v: Column) -> Column:
    guess = F.floor(F.log10(F.abs(v)))
    ten = lambda e: F.pow(F.lit(10.0), e.cast("double"))
    decade = guess + F.when(ten(guess + 1) <= F.abs(v), 1).when(ten(guess) > F.abs(v), -1).otherwise(0)

    def rounded(d):
        scaled = F.when(d <= 11, v * ten(11 - d)).otherwise(v / ten(d - 11))
        back = F.when(d <= 11, F.rint(scaled) / ten(11 - d)).otherwise(F.rint(scaled) * ten(d - 11))
        tie = F.abs(F.abs(scaled - F.floor(scaled)) - 0.5) < 1e-9
        return F.when(~tie & (F.abs(back - v) <= ten(d) * 1e-12), back).otherwise(v)

    return let(decade, rounded)


def is_exact(c: Column) -> Column:
    """Cleaning would not change the value."""
    return clean_double(c).eqNullSafe(c.cast("double"))


def plain_text(c: Column) -> Column:
    """Number as decimal digits: no exponent, no trailing '.0', no '-0'."""
    v = c.cast("double") + F.lit(0.0)
    whole = (v == F.rint(v)) & (F.abs(v) < 9.2e18)
    text = v.cast("string")
    return F.when(whole, v.cast("bigint").cast("string")).when(text.rlike("^-?[0-9.]+E"), let(text, _written_out)).otherwise(text)


def _written_out(text: Column) -> Column:
    """Digits of an exponent form like -1.25E-7."""
    parts = F.struct(
        F.when(text.startswith("-"), "-").otherwise("").alias("sign"),
        F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "E.*$", ""), "[-.]", ""), "(?<=.)0+$", "").alias("digits"),
        F.regexp_extract(text, "E(-?[0-9]+)$", 1).cast("int").alias("e"))

    def join(x):
        d, e, n = x["digits"], x["e"], F.length(x["digits"])
        large = F.rpad(d, e + 1, "0")
        tiny = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        mid = F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n))
        return F.concat(x["sign"], F.when(e < 0, tiny).when(n <= e + 1, large).otherwise(mid))

    return let(parts, join)


def clean_text(c: Column) -> Column:
    return plain_text(clean_double(c))


#: ASCII decimal spelling of a number.
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,9})?$"


def numeric_key_text(c: Column) -> Column:
    """One text for all spellings of one decimal number (``01``, ``1.0``, ``1E0``, ``+1``: ``1``), else NULL.

    Exact for any number of digits; an exponent beyond 400 keeps a scientific form.
    """
    plain = F.coalesce(c.rlike("^[1-9][0-9]*$"), F.lit(False))
    return F.when(plain, c).when(F.coalesce(c.rlike(NUMBER), F.lit(False)), let(c, _canonical))


def _canonical(c: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(c, "[eE].*$", ""), "^[+-]", "")
    parts = F.struct(
        F.when(c.startswith("-"), "-").otherwise("").alias("sign"),
        F.regexp_replace(F.replace(body, F.lit("."), F.lit("")), "^0+", "").alias("digits"),
        (F.coalesce(F.regexp_extract(c, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0)) - F.length(F.regexp_extract(body, r"\.([0-9]*)$", 1))).alias("scale"))

    def trimmed(x):  # value = bare * 10**scale
        bare = F.regexp_replace(x["digits"], "0+$", "")
        return F.struct(x["sign"].alias("sign"), bare.alias("bare"), (x["scale"] + F.length(x["digits"]) - F.length(bare)).alias("scale"))

    def join(x):
        bare, scale, n = x["bare"], x["scale"], F.length(x["bare"])
        whole = F.concat(bare, F.repeat(F.lit("0"), scale))
        mixed = F.concat(F.substring(bare, F.lit(1), n + scale), F.lit("."), F.substring(bare, n + scale + 1, n))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -(n + scale)), bare)
        text = F.when(F.abs(scale) > 400, F.concat(bare, F.lit("E"), scale.cast("string"))).when(scale >= 0, whole).when(n + scale > 0, mixed).otherwise(below)
        return F.when(bare == "", F.lit("0")).otherwise(F.concat(x["sign"], text))

    return let(let(parts, trimmed), join)


def join_token(c: Column, numeric_parent: bool) -> Column:
    """Text of a pointer value: stripped, and canonical where the pointed-at column is numeric."""
    s = strip(c)
    return F.coalesce(numeric_key_text(s), s) if numeric_parent else s


def float_exact(c: Column) -> Column:
    """The double is exactly a float."""
    return (c.cast("float").cast("double") == c) | F.isnan(c)


def float_representable(c: Column) -> Column:
    """The double's shortest text is that of a float."""
    return c.cast("float").cast("string") == c.cast("string")


def float_to_double(c: Column) -> Column:
    """Float to double through its shortest text."""
    return c.cast("float").cast("string").cast("double")


def to_long(c: Column, kind: str) -> Column:
    """LONG from any logical type: numbers are truncated, text must be a whole number."""
    if kind == "STRING":
        return F.when(strip(c).rlike(r"^[+-]?[0-9]+$"), strip(c).try_cast("bigint"))
    if kind == "BOOLEAN":
        return c.cast("bigint")
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 9.2233720368547758e18), c.try_cast("bigint"))


def to_double(c: Column, kind: str) -> Column:
    return c.cast("bigint").cast("double") if kind == "BOOLEAN" else (store_double(strip(c).try_cast("double")) if kind == "STRING" else store_double(c.cast("double")))


def to_boolean(c: Column, kind: str) -> Column:
    if kind == "BOOLEAN":
        return c
    if kind == "STRING":
        s = F.lower(strip(c))
        return F.when(s == "true", True).when(s == "false", False).otherwise(s.try_cast("double") != 0)
    return c.cast("double") != 0


def to_text(c: Column, kind: str) -> Column:
    return c if kind == "STRING" else (c.cast("string") if kind in ("BOOLEAN", "LONG", "OTHER") else clean_text(c))


def list_cell(c: Column) -> Column:
    """A list as one text cell: ', ' between, nulls empty."""
    return F.array_join(F.transform(c.cast("array<string>"), lambda x: F.coalesce(x, F.lit(""))), ", ")


def is_sentinel(c: Column) -> Column:
    """Text of a missing marker of the dot family."""
    return F.coalesce(c.rlike(r"^\.[_A-Z]?$"), F.lit(False))


def sentinel_code(c: Column) -> Column:
    """Code of a dot-family marker's text: '.' 64, '._' 60, '.A' to '.Z' 65 to 90."""
    return F.when(~is_sentinel(c), None).when(c == ".", 64).when(c == "._", 60).otherwise(F.ascii(F.substring(c, 2, 1))).cast("tinyint")


def is_missing(c: Column) -> Column:
    return c.isNull()


def is_empty_or_missing(c: Column, kind: str) -> Column:
    return c.isNull() | (c == "") if kind == "STRING" else c.isNull()


def is_blank(c: Column, kind: str) -> Column:
    """Missing, empty or only white space."""
    return c.isNull() | (strip(c) == "") if kind == "STRING" else c.isNull()
