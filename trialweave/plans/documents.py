"""Queries of dictionaries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model.table import ROW, number_rows
from ..operators.dictionary import Dictionary, by_version
from ..operators.report import findings, summary
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


def places(spark, sf_dir) -> Dictionary:
    """Nations and regions as a terminology of two levels."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    levels = n.select(F.lit("NATION").alias("level"), F.col("n_name").alias("term")).unionByName(r.select(F.lit("REGION").alias("level"), F.col("r_name").alias("term")))
    pairs = n.select(F.lit("nation").alias("registry"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("decode"))
    edges = both.select(F.lit("NATION").alias("level"), F.col("n_name").alias("term"), F.lit("REGION").alias("up_level"), F.col("r_name").alias("ancestor"))
    return Dictionary(levels, pairs, edges)


@query("""SELECT c_custkey, upper(t) IN (SELECT upper(n_name) FROM nation) AS valid, t IN (SELECT n_name FROM nation) AS exact
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN n_name || c_custkey WHEN c_custkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def dictionary_valid_term(spark, sf_dir):
    """Membership with and without case; even customers spell the preferred form, odd ones in lower case, some a term that is none."""
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    term = F.when(F.col("c_custkey") % 7 == 0, F.concat("n_name", F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name"))
    out = places(spark, sf_dir).check_terms(c.select("c_custkey", term.alias("t")), "t", "NATION")
    return out.select("c_custkey", "valid", "exact")


@query("""WITH m AS (SELECT unnest(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']) AS name, unnest(range(1, 13)) AS m),
w AS (SELECT DISTINCT 'whodrug' AS kind, CASE WHEN c_custkey % 50 = 0 THEN 'draft' || (c_custkey % 3) ELSE name || '_' || (2000 + c_custkey % 21) END AS token, CASE WHEN c_custkey % 50 <> 0 THEN 12 * (2000 + c_custkey % 21) + m END AS k FROM customer JOIN m ON m = 1 + c_custkey % 12),
d AS (SELECT DISTINCT 'meddra' AS kind, (c_custkey % 23) || '.' || (c_custkey % 13) AS token, (c_custkey % 23) * 100 + c_custkey % 13 AS k FROM customer)
SELECT kind, token, row_number() OVER (PARTITION BY kind ORDER BY k DESC NULLS LAST, token DESC) AS place FROM (SELECT * FROM w UNION ALL SELECT * FROM d)""")
def dictionary_version_order(spark, sf_dir):
    """Versions by what they say, not by their text; what is none comes last."""
    c = read(spark, sf_dir, "customer")
    names = F.array(*map(F.lit, ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")))
    year = (F.lit(2000) + F.col("c_custkey") % 21).cast("string")
    month = F.concat(F.element_at(names, (F.col("c_custkey") % 12 + 1).cast("int")), F.lit("_"), year)
    tokens = {"whodrug": F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("draft"), (F.col("c_custkey") % 3).cast("string"))).otherwise(month), "meddra": F.concat((F.col("c_custkey") % 23).cast("string"), F.lit("."), (F.col("c_custkey") % 13).cast("string"))}
    out = None
    for kind, token in tokens.items():
        placed = number_rows(by_version(c.select(token.alias("token")).distinct(), kind, "token"))
        one = placed.select(F.lit(kind).alias("kind"), "token", (F.col(ROW) + 1).alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT s_suppkey, n_name AS decode FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def dictionary_decode(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("code"))
    return places(spark, sf_dir).decode(s, "code", "nation").select("s_suppkey", "decode")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN false ELSE true END AS pair FROM supplier")
def dictionary_code_pair(spark, sf_dir):
    """Whether a code and its decode belong together."""
    s = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("s_suppkey", F.col("s_nationkey").cast("string").alias("code"), F.when(F.col("s_suppkey") % 3 == 0, "elsewhere").otherwise(F.upper("n_name")).alias("d"))
    return places(spark, sf_dir).code_pair(s, "code", "d", "nation").select("s_suppkey", "pair")


@query("SELECT s_suppkey, r_name = 'ASIA' AS under FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dictionary_hierarchy_path(spark, sf_dir):
    """Whether a term lies under an ancestor of a level."""
    s = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("t"))
    return places(spark, sf_dir).under(s, "t", "NATION", "REGION", "ASIA").select("s_suppkey", "under")


@query("SELECT 'CUST-NEG' AS rule, 'CUSTOMER' AS dataset, 'ERROR' AS severity, count(*) AS n, min(c_custkey) + 1 AS first_row FROM customer WHERE c_acctbal < 0")
def report_findings(spark, sf_dir):
    """Findings of a rule as rows, summed up."""
    c = keyed(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return summary(findings(c, "CUST-NEG", F.col("c_acctbal") < 0, ["c_acctbal"], "ERROR")).select("rule", "dataset", "severity", "n", "first_row")
