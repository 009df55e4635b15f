"""Queries of projections, row maps, unions, overlays, groups and content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import comparable
from ..model.table import ROW, Table
from ..operators.relational import content, distinct_in_order, equal, group_blocks, max_bytes, overlay, project, row_map, row_slice, union, with_group, zip_tables
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


@query("SELECT c_name, c_custkey, c_name AS c_name_2, '' AS V4 FROM customer")
def table_projection(spark, sf_dir):
    """Reordered and repeated columns, and one without backing."""
    return project(keyed(spark, sf_dir, "customer"), ["C_NAME", "c_custkey", "c_name", None]).df.drop(ROW)


@query("SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS out_row, s_name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 1000000, ''")
def table_row_map(spark, sf_dir):
    """A filtered, sorted view by a row map, with one row of defaults."""
    t = keyed(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_acctbal"])
    from ..model.table import number_rows

    view = number_rows(t.df.where("s_acctbal > 0").select(F.col(ROW).alias("base_row"), "s_acctbal", "s_suppkey"), [F.desc("s_acctbal"), "s_suppkey"]).select(F.col(ROW).alias("out_row"), "base_row")
    view = view.unionByName(spark.createDataFrame([(1000000, -1)], "out_row bigint, base_row bigint"))
    return row_map(t, view).df.select(F.col(ROW).alias("out_row"), "s_name")


@query("""SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS shown, s_suppkey AS real, s_name FROM (SELECT * FROM supplier WHERE s_acctbal > 0) WHERE s_suppkey % 2 = 0""")
def table_real_rows(spark, sf_dir):
    """A view of a view: every shown row knows the row of the first table."""
    from ..model.table import number_rows

    def view(t, rows):
        picked = number_rows(rows.select(F.col(ROW).alias("base_row")), ["base_row"])
        return row_map(t, picked.select(F.col(ROW).alias("out_row"), "base_row"))

    t = keyed(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_acctbal"])
    t = view(t, t.df.where("s_acctbal > 0"))
    t = view(t, t.df.where("s_suppkey % 2 = 0"))
    return t.df.select(F.col(ROW).alias("shown"), F.col("__base_row").alias("real"), "s_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey >= 100 AND p_partkey < 300")
def table_slice(spark, sf_dir):
    return row_slice(keyed(spark, sf_dir, "part", ["p_partkey", "p_name"]), 100, 300).df.drop(ROW)


@query("""SELECT c_custkey, c_name, c_acctbal * 2 AS twice, (SELECT count(*) FROM supplier) <> (SELECT count(*) FROM nation) AS unequal_refused FROM customer""")
def table_zip(spark, sf_dir):
    """Two tables of equal length side by side by row position; unequal ones are refused."""
    a = keyed(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    b = keyed(spark, sf_dir, "customer", ["c_acctbal"])
    b = b.with_df(b.df.select(ROW, (F.col("c_acctbal") * 2).alias("twice")))
    try:
        zip_tables(keyed(spark, sf_dir, "supplier", ["s_name"]), keyed(spark, sf_dir, "nation", ["n_name"]))
        refused = False
    except ValueError:
        refused = True
    return zip_tables(a, b).df.select("c_custkey", "c_name", "twice", F.lit(refused).alias("unequal_refused"))


@query("SELECT c_custkey AS key_, c_name AS name_, c_mktsegment AS segment, NULL::DOUBLE AS balance, 0 AS member FROM customer UNION ALL SELECT s_suppkey, s_name, '', s_acctbal, 1 FROM supplier")
def table_union(spark, sf_dir):
    """Union by name: absent text is '', absent numbers are missing."""
    c = keyed(spark, sf_dir, "customer")
    c = c.with_df(c.df.select(ROW, F.col("c_custkey").alias("key_"), F.col("c_name").alias("name_"), F.col("c_mktsegment").alias("segment")))
    s = keyed(spark, sf_dir, "supplier")
    s = s.with_df(s.df.select(ROW, F.col("s_suppkey").alias("KEY_"), F.col("s_name").alias("name_"), F.col("s_acctbal").alias("balance")))
    return union(c, s).df.select("key_", "name_", "segment", "balance", F.col("__member").alias("member"))


@query("SELECT o_orderkey, '' AS remark, 0 AS member FROM orders UNION ALL SELECT l_orderkey, l_returnflag, 1 FROM lineitem")
def table_union_blank_yields(spark, sf_dir):
    """A blank numeric column gives way to text of the same name."""
    o = keyed(spark, sf_dir, "orders", ["o_orderkey"])
    o = o.with_df(o.df.withColumn("remark", F.lit(None).cast("double")))
    x = keyed(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"])
    x = x.with_df(x.df.withColumnsRenamed({"l_orderkey": "o_orderkey", "l_returnflag": "remark"}))
    return union(o, x).df.select("o_orderkey", "remark", F.col("__member").alias("member"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'edited' ELSE c_name END AS c_name, c_acctbal * 2 AS twice FROM customer")
def table_overlay(spark, sf_dir):
    t = keyed(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    edits = t.df.where("c_custkey % 10 = 0").select(F.col(ROW).alias("row"), F.lit("edited").alias("value"))
    out = overlay(t, edits, "c_name", add={"twice": F.col("c_acctbal") * 2}, drop=["c_mktsegment"], rename={"c_custkey": "id"}, labels={"c_name": "Name"})
    return out.df.select("id", "c_name", "twice")


@query("""SELECT 'itself' AS against, true AS same UNION ALL SELECT 'upper case', (SELECT bool_and(upper(c_name) = c_name) FROM customer)
UNION ALL SELECT 'without 3', (SELECT count(*) = 0 FROM customer WHERE c_custkey = 3) UNION ALL SELECT 'half as much twice', true UNION ALL SELECT 'balance of 7 changed', (SELECT count(*) = 0 FROM customer WHERE c_custkey = 7)
UNION ALL SELECT 'marker changed', (SELECT count(*) = 0 FROM customer WHERE c_custkey % 5 = 0) UNION ALL SELECT 'other columns', false""")
def table_equality(spark, sf_dir):
    """Cells, markers, rows and columns tell tables apart."""
    t = keyed(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"])
    t = t.with_df(t.df.withColumn("gap", F.when(F.col("c_custkey") % 5 != 0, 1.0)))
    put = lambda **c: t.with_df(t.df.withColumns(c))
    others = {
        "itself": t, "upper case": put(c_name=F.upper("c_name")), "without 3": t.with_df(t.df.where("c_custkey <> 3")), "half as much twice": put(c_acctbal=F.col("c_acctbal") / 2 * 2),
        "balance of 7 changed": put(c_acctbal=F.when(F.col("c_custkey") == 7, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))),
        "marker changed": put(gap__mis=F.when(F.col("gap").isNull(), 65).cast("tinyint")), "other columns": t.with_df(t.df.drop("gap")),
    }
    return spark.createDataFrame([(k, equal(t, x)) for k, x in others.items()], "against string, same boolean")


@query("""SELECT 'o_orderstatus' AS "column", CASE WHEN bool_or(o_orderstatus <> '') THEN 'FILLED' WHEN bool_or(o_orderstatus = '') THEN 'EMPTY' ELSE 'MISSING' END AS status, count(DISTINCT o_orderstatus) <= 1 AS uniform FROM orders
UNION ALL SELECT 'none', 'MISSING', true UNION ALL SELECT 'blank', 'EMPTY', true UNION ALL SELECT 'one', 'FILLED', true""")
def table_content(spark, sf_dir):
    t = keyed(spark, sf_dir, "orders", ["o_orderstatus", "o_orderkey"])
    t = t.with_df(t.df.drop("o_orderkey").withColumn("none", F.lit(None).cast("double")).withColumn("blank", F.lit("")).withColumn("one", F.lit(1)))
    return content(t)


@query("SELECT coalesce(max(octet_length(encode(text))), 0) AS text, coalesce(max(octet_length(encode(lang))), 0) AS lang, coalesce(max(octet_length(encode(source))), 0) AS source FROM documents")
def table_max_bytes(spark, sf_dir):
    """UTF-8 lengths, of texts with letters of several bytes."""
    return max_bytes(keyed(spark, sf_dir, "documents", ["text", "lang", "source"]))


@query("""SELECT row_number() OVER (ORDER BY first_row) - 1 AS block, first_row, n FROM (SELECT min(o_orderkey) AS first_row, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)""")
def table_group_blocks(spark, sf_dir):
    """Blocks of equal keys in order of first appearance."""
    return group_blocks(keyed(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]), ["o_orderstatus", "o_orderpriority"]).select("block", "first_row", "n")


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_of_group FROM orders")
def table_group_of_row(spark, sf_dir):
    t = keyed(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return with_group(t, ["o_custkey"]).select("o_orderkey", F.col("__first").alias("first_of_group"))


@query("SELECT p_brand, min(p_partkey) AS first_row FROM part GROUP BY 1")
def table_distinct_in_order(spark, sf_dir):
    return distinct_in_order(keyed(spark, sf_dir, "part", ["p_partkey", "p_brand"]), "p_brand")


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value, CASE event_id % 18 WHEN 0 THEN 65 WHEN 9 THEN 64 END AS code FROM events)
SELECT event_id, row_number() OVER (ORDER BY value IS NOT NULL, code, value, event_id) AS place FROM t""")
def table_value_order(spark, sf_dir):
    """The value comparator: missing markers first by code, then numbers."""
    t = keyed(spark, sf_dir, "events", ["event_id", "value"])
    code = F.when(F.col("event_id") % 18 == 0, 65).when(F.col("event_id") % 9 == 0, 64).cast("tinyint")
    t = t.with_df(t.df.withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value"))).withColumn("value__mis", code))
    from ..model.table import number_rows

    out = number_rows(t.df.select("event_id", *t.df.columns[1:2], "value__mis").select("event_id", "value", "value__mis"), [F.col("value").isNotNull().asc(), F.col("value__mis").asc(), F.col("value").asc(), F.col("event_id").asc()])
    assert len(comparable(t, "value")) == 3
    return out.select("event_id", (F.col(ROW) + 1).alias("place"))


@query("SELECT doc_id, text IS NULL AS missing, coalesce(text, '') = '' AS empty FROM documents")
def table_blankness(spark, sf_dir):
    from ..functions.values import is_empty_or_missing, is_missing

    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", is_missing(F.col("text")).alias("missing"), is_empty_or_missing(F.col("text"), "STRING").alias("empty"))
