"""Queries of scalar functions: numbers, keys, conversions, dates, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import values as V
from ..functions.formats import codelist_alias, codelist_format, is_unwrapped_time, spelled
from ..functions.keys import coalesced, tag, text_tag
from ..model.table import Table
from .common import keyed, read

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS cleaned, true AS near FROM lineitem")
def scalar_clean_double(spark, sf_dir):
    """Products of prices freed of binary noise."""
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("v"))
    c = V.clean_double(F.col("v"))
    return x.select("l_orderkey", "l_linenumber", F.round(c, 6).alias("cleaned"), (F.abs(c - F.col("v")) <= 1e-11 * F.greatest(F.abs("v"), F.lit(1e-12))).alias("near"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE (o_orderkey || '.5') END AS t FROM orders")
def scalar_plain_text(spark, sf_dir):
    v = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(0.5)
    return read(spark, sf_dir, "orders").select("o_orderkey", V.plain_text(v).alias("t"))


@query("SELECT p_partkey, p_size::VARCHAR AS a, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || '00' END AS b FROM part")
def scalar_numeric_key_text(spark, sf_dir):
    """Many spellings of one number are one key."""
    s = F.col("p_size").cast("string")
    spelled = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("00"), s, F.lit(".0"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("+"), s, F.lit("E0"))).when(F.col("p_partkey") % 4 == 2, F.concat(s, F.lit("e2"))).otherwise(F.concat(s, F.lit("x")))
    return read(spark, sf_dir, "part").select("p_partkey", V.numeric_key_text(F.concat(F.lit("0"), s)).alias("a"), V.numeric_key_text(spelled).alias("b"))


@query("SELECT count(DISTINCT l_quantity) AS n, count(DISTINCT l_quantity) AS n_text FROM lineitem")
def scalar_key_tags(spark, sf_dir):
    """LONG and DOUBLE of one value share a key; so do numbers and their text under the text key."""
    x = keyed(spark, sf_dir, "lineitem", ["l_quantity"])
    whole = Table(x.df.withColumn("l_quantity", F.col("l_quantity").cast("bigint")))
    a = x.df.select(tag(x, "l_quantity").alias("k")).union(whole.df.select(tag(whole, "l_quantity"))).agg(F.count_distinct("k").alias("n"))
    as_text = Table(x.df.withColumn("l_quantity", V.plain_text(F.col("l_quantity"))))
    b = x.df.select(text_tag(x, "l_quantity").alias("k")).union(as_text.df.select(text_tag(as_text, "l_quantity"))).agg(F.count_distinct("k").alias("n_text"))
    return a.crossJoin(F.broadcast(b))  # one row each


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), source) AS k FROM documents")
def scalar_coalesced_key(spark, sf_dir):
    t = keyed(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    t = t.with_df(t.df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))))
    return t.df.select("doc_id", F.substring(coalesced(t, ["lang", "source"]), 3, 100).alias("k"))


@query("""SELECT c_custkey, trunc(c_acctbal)::BIGINT AS as_long, c_acctbal <> 0 AS as_boolean, c_custkey::DOUBLE AS as_double,
CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS text_long FROM customer""")
def scalar_conversions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    s = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).otherwise("n/a")
    return c.select("c_custkey", V.to_long(F.col("c_acctbal"), "DOUBLE").alias("as_long"), V.to_boolean(F.col("c_acctbal"), "DOUBLE").alias("as_boolean"), V.to_double(F.col("c_custkey").cast("string"), "STRING").alias("as_double"), V.to_long(s, "STRING").alias("text_long"))


@query("SELECT l_orderkey, l_linenumber, l_discount::FLOAT::DOUBLE = l_discount AS exact, true AS shortest FROM lineitem")
def scalar_float_exact(spark, sf_dir):
    v = F.col("l_discount")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.float_exact(v).alias("exact"), V.float_representable(v).alias("shortest"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 64 WHEN 1 THEN 60 WHEN 2 THEN 65 + event_id % 26 END::TINYINT AS code FROM events")
def scalar_sentinel_codes(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, ".").when(e % 4 == 1, "._").when(e % 4 == 2, F.concat(F.lit("."), F.char(65 + e % 26))).otherwise("5")
    return read(spark, sf_dir, "events").select("event_id", V.sentinel_code(text).alias("code"))


@query("SELECT n_nationkey, n_name || ', , ' || n_regionkey AS cell FROM nation")
def scalar_list_cell(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", V.list_cell(F.array(F.col("n_name"), F.lit(None).cast("string"), F.col("n_regionkey").cast("string"))).alias("cell"))


@query("SELECT n_nationkey, n_name AS t FROM nation")
def scalar_strip(spark, sf_dir):
    """White space as the JVM strips it: tabs and wide spaces."""
    return read(spark, sf_dir, "nation").select("n_nationkey", V.strip(F.concat(F.lit("\t  "), "n_name", F.lit(" \n"))).alias("t"))


@query("""SELECT o_orderkey, (date_diff('day', DATE '1960-01-01', o_orderdate::DATE))::DOUBLE AS days, date_diff('second', TIMESTAMP '1960-01-01', o_orderdate)::DOUBLE AS seconds,
strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS dt FROM orders""")
def scalar_dates(spark, sf_dir):
    """Days and seconds from 1960, and back to text."""
    o = read(spark, sf_dir, "orders").withColumn("days", D.days(F.col("o_orderdate"))).withColumn("seconds", D.seconds(F.col("o_orderdate")))
    return o.select("o_orderkey", "days", "seconds", D.date_text(F.col("days")).alias("d"), D.datetime_text(F.col("seconds")).alias("dt"))


@query("SELECT event_id, (event_id % 86400)::DOUBLE AS s FROM events")
def scalar_times(spark, sf_dir):
    """Seconds to ISO time text and back."""
    return read(spark, sf_dir, "events").select("event_id", D.time_seconds(D.time_text(F.col("event_id") % 86400)).alias("s"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'DATE_SAS' WHEN 1 THEN 'DATETIME_SAS' WHEN 2 THEN 'TIME_SAS' ELSE 'OTHER' END AS category FROM part")
def scalar_format_category(spark, sf_dir):
    k = F.col("p_partkey") % 5
    f = F.when(k == 0, "DATE9.").when(k == 1, "e8601dt19.").when(k == 2, "TIME8.").when(k == 3, "BEST12.2").otherwise("$CHAR20.")
    return read(spark, sf_dir, "part").select("p_partkey", D.category_column(f).alias("category"))


@query("SELECT p_partkey, (p_partkey - 21916) * 86400.0::DOUBLE AS s FROM part")
def scalar_excel_serial(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", D.excel_seconds(F.col("p_partkey")).cast("double").alias("s"))


@query("""SELECT p_partkey, p_size % 4 IN (0, 3) AS unwrapped FROM part""")
def scalar_unwrapped_time(spark, sf_dir):
    """Times that are not taken modulo a day, by format with and without width."""
    names = F.array(*map(F.lit, ("TIME8.", "tod5.", "DATETIME20.", "e8601tm")))
    return read(spark, sf_dir, "part").select("p_partkey", is_unwrapped_time(F.element_at(names, (F.col("p_size") % 4 + 1).cast("int"))).alias("unwrapped"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '$' || c_mktsegment ELSE c_mktsegment END AS format,
CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN '$F' || c_custkey WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 1 THEN 'F' || c_custkey END AS alias FROM customer""")
def scalar_codelist_formats(spark, sf_dir):
    """Format names of code lists, and usable further names: with a $ exactly for text, not equal but for case."""
    text = F.col("c_custkey") % 2 == 0
    number = F.col("c_custkey").cast("string")
    given = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("$F"), number)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("F"), number)).otherwise(F.lower(codelist_format(F.col("c_mktsegment"), text)))
    return read(spark, sf_dir, "customer").select("c_custkey", codelist_format(F.col("c_mktsegment"), text).alias("format"), codelist_alias(F.col("c_mktsegment"), given, text).alias("alias"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 3 > 0 THEN 'BEST' || p_size || '.' || (p_size % 3) ELSE 'BEST' || p_size || '.' END
WHEN 1 THEN '$CHAR' || p_size || '.' WHEN 2 THEN p_size || '.' || CASE WHEN p_size % 3 > 0 THEN (p_size % 3)::VARCHAR ELSE '' END WHEN 3 THEN 'DATE9.' END AS format FROM part""")
def scalar_format_spelling(spark, sf_dir):
    """Stored names, widths and decimals spelled as one."""
    kind, size = F.col("p_partkey") % 5, F.col("p_size")
    name = F.when(kind == 0, " BEST ").when(kind == 1, "$CHAR").when(kind == 2, "").when(kind == 3, "DATE9.")
    return read(spark, sf_dir, "part").select("p_partkey", spelled(name, F.when(kind < 3, size).otherwise(0), F.when(kind == 3, 0).otherwise(size % 3), (kind != 1) & (kind != 4)).alias("format"))
