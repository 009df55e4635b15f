"""Queries of readers and writers: driver tables written in a format into the shared folder and read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.table import ROW
from ..operators.relational import union
from ..shared import shared_dir
from ..sources import catalog, cdt, transport
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


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sources/{uuid.uuid4().hex}/{name}"


def _put(spark: SparkSession, path: str, content: bytes) -> str:
    """A small file, written through Hadoop: any store will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()
    return path


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal, count(*) OVER () AS n_rows FROM customer")
def source_csv(spark, sf_dir):
    """Delimited text in several files, split over tasks: types are found, rows numbered through."""
    path = _place(spark, "customer.csv")
    read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").repartition(3, "c_custkey").write.option("header", True).csv(path)
    t = catalog.read(spark, path)
    n = t.df.agg(F.count_distinct(ROW), F.min(ROW), F.max(ROW)).first()
    n_rows = F.when(F.lit(n[0] == n[2] - n[1] + 1 and n[1] == 0), F.lit(n[0])).cast("bigint")
    return t.df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment", "c_acctbal", n_rows.alias("n_rows"))


@query("""SELECT c_custkey, c_name || chr(10) || '"' || c_mktsegment || '", x' AS note, CASE WHEN c_custkey % 3 = 0 THEN 65 WHEN c_custkey % 3 = 1 THEN 64 END AS code, CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END AS balance, '1' AS said FROM customer""")
def source_csv_quotes(spark, sf_dir):
    """Quoted line breaks and quotes; unquoted dots are missing markers, quoted numbers are text."""
    path = _place(spark, "notes.csv")
    note = F.concat(F.lit('"'), "c_name", F.lit('\n""'), "c_mktsegment", F.lit('"", x"'))
    balance = F.when(F.col("c_custkey") % 3 == 0, ".A").when(F.col("c_custkey") % 3 == 1, ".").otherwise(F.col("c_acctbal").cast("string"))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), note, balance, F.lit('"1"'))
    lines = read(spark, sf_dir, "customer").select("c_custkey", line.alias("value"))
    head = spark.createDataFrame([(-1, "c_custkey,note,balance,said")], "c_custkey bigint, value string")
    lines.unionByName(head).repartition(1).sortWithinPartitions("c_custkey").select("value").write.text(path)  # one file has one header
    t = catalog.read(spark, path)
    return t.df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "note", F.col("balance__mis").cast("int").alias("code"), "balance", "said")


def _columns(*columns: tuple[str, str]) -> list[dict]:
    return [{"itemOID": f"IT.{n}", "name": n, "label": n.title(), "dataType": k} for n, k in columns]


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority, o_orderkey % 2 = 0 AS even FROM orders")
def source_ndjson(spark, sf_dir):
    """NDJSON in several files: the first line of the first is metadata; null cells are missing."""
    path = _place(spark, "orders.ndjson")
    orders = read(spark, sf_dir, "orders")
    head = {"datasetJSONVersion": "1.1.0", "name": "ORDERS", "label": "Orders", "columns": _columns(("o_orderkey", "integer"), ("o_totalprice", "double"), ("o_orderstatus", "string"), ("priority", "string"), ("even", "boolean"))}
    cells = [F.to_json(F.struct(v.alias("x"))) for v in (F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")), F.col("o_orderkey") % 2 == 0)]
    bare = [F.when(c == "{}", "null").otherwise(F.substring(c, 6, F.length(c) - 6)) for c in (F.col(f"c{i}") for i in range(len(cells)))]
    lines = orders.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).select(F.concat(F.lit("["), F.concat_ws(",", *bare), F.lit("]")).alias("value"))
    lines.write.text(path)
    _put(spark, f"{path}/0-head.ndjson", (json.dumps(head) + "\n").encode())
    t = catalog.read(spark, path)
    return t.df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice", "o_orderstatus", "priority", "even")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey END AS n_regionkey, 25 AS records FROM nation")
def source_dataset_json(spark, sf_dir):
    """One Dataset-JSON document with its declared number of records."""
    rows = [[r["n_nationkey"], r["n_name"], r["n_regionkey"] if r["n_nationkey"] % 4 else None] for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").limit(1000).collect()]  # 25 nations
    head = {"datasetJSONVersion": "1.1.0", "name": "NATION", "records": len(rows), "columns": _columns(("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer")), "rows": rows}
    t = catalog.read(spark, _put(spark, _place(spark, "nation.json"), json.dumps(head).encode()))
    return t.df.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"), F.lit(t.meta["records"]).alias("records"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey / -8.0 END AS eighth, 'Nations' AS label FROM nation")
def source_transport(spark, sf_dir):
    """A transport file: hexadecimal floats and missing markers survive exactly."""
    rows = [(float(r["n_nationkey"]), r["n_name"], r["n_nationkey"] / -8.0 if r["n_nationkey"] % 3 else None) for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").limit(1000).collect()]  # 25 nations
    columns = [{"name": "NKEY", "number": True, "length": 8}, {"name": "NAME", "number": False, "length": 30}, {"name": "EIGHTH", "number": True, "length": 8}]
    t = catalog.read(spark, _put(spark, _place(spark, "nation.xpt"), transport.file_of("NATION", "Nations", columns, rows)))
    return t.df.select(F.col("NKEY").cast("bigint").alias("n_nationkey"), F.col("NAME").alias("n_name"), F.col("EIGHTH").alias("eighth"), F.lit(t.label).alias("label"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal END AS balance, CASE WHEN s_suppkey % 7 = 0 THEN 67 END AS code, s_name || ' | \"q\" .' AS s_name FROM supplier")
def source_cdt(spark, sf_dir):
    """CDT text written by Spark and read back: bars, quotes and markers."""
    s = keyed(spark, sf_dir, "supplier", ["s_suppkey", "s_acctbal", "s_name"])
    marked = F.col("s_suppkey") % 7 == 0
    t = s.with_df(s.df.withColumns({"balance": F.when(~marked, F.col("s_acctbal")), "balance__mis": F.when(marked, 67).cast("tinyint"), "s_name": F.concat("s_name", F.lit(' | "q" .'))}).drop("s_acctbal"))
    path = _place(spark, "supplier.cdt")
    cdt.write(t, path)
    back = catalog.read(spark, path)
    return back.df.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "balance", F.col("balance__mis").cast("int").alias("code"), "s_name")


@query("""SELECT o_orderkey, date_diff('day', DATE '1960-01-01', o_orderdate::DATE)::DOUBLE AS day_1960, o_totalprice, count(*) OVER () AS n_rows FROM orders""")
def source_parquet(spark, sf_dir):
    """Parquet: dates count from 1960; rows are numbered by the scan."""
    path = _place(spark, "orders.parquet")
    read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day_1960"), "o_totalprice").repartition(4, "o_orderkey").write.parquet(path)
    t = catalog.read(spark, path)
    n = t.df.agg(F.count_distinct(ROW), F.min(ROW), F.max(ROW)).first()
    return t.df.select("o_orderkey", "day_1960", "o_totalprice", F.when(F.lit(n[0] == n[2] + 1 and n[1] == 0), F.lit(n[0])).cast("bigint").alias("n_rows"))


@query("""SELECT * FROM (VALUES ('o_orderkey', 'LONG'), ('o_orderdate', 'DOUBLE'), ('o_totalprice', 'DOUBLE'), ('o_orderstatus', 'STRING')) AS c("column", kind), (SELECT count(*) AS n_rows FROM orders)""")
def source_described(spark, sf_dir):
    """Columns and rows of a file without reading its cells."""
    path = _place(spark, "orders.parquet")
    read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice", "o_orderstatus").write.parquet(path)
    columns, n = catalog.describe(spark, path)
    return spark.createDataFrame([(c["name"], c["kind"], n) for c in columns], "column string, kind string, n_rows bigint")


@query("""SELECT 'csv' AS what, 'UTF-8' AS encoding, 'DEFAULT' AS source, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'csv as latin-1', 'ISO-8859-1', 'CONFIGURED', (SELECT count(*) FROM region)
UNION ALL SELECT 'both', 'MIXED', 'DEFAULT', 2 * (SELECT count(*) FROM region)""")
def source_encoding(spark, sf_dir):
    """What is known of a table's encoding, and of a union's."""
    path = _place(spark, "region.csv")
    read(spark, sf_dir, "region").select("r_regionkey", "r_name").write.option("header", True).csv(path)
    a, b = catalog.read(spark, path), catalog.read(spark, path, encoding="ISO-8859-1")
    found = {"csv": a, "csv as latin-1": b, "both": union(a, b)}
    return spark.createDataFrame([(k, t.meta["Encoding"], t.meta["EncodingSource"], t.df.count()) for k, t in found.items()], "what string, encoding string, source string, n bigint")


@query("SELECT 'region' AS member, 5 AS n_rows UNION ALL SELECT 'nation', 25")
def source_folder(spark, sf_dir):
    """A folder as a library: its members by name, and their rows."""
    path = _place(spark, "library")
    for name in ("region", "nation"):
        t = keyed(spark, sf_dir, name)
        _put(spark, f"{path}/{name}.cdt", cdt.to_text(t).encode())
    _put(spark, f"{path}/notes.md", b"not a table")
    out: DataFrame | None = None
    for name, uri in catalog.folder(spark, path).items():
        one = catalog.read(spark, uri).df.agg(F.lit(name).alias("member"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out



