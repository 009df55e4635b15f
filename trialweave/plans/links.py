"""Queries of the rules of relationships and supplemental qualifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.table import ROW, Table
from ..operators.merge import CardinalityViolation, Keyed, merge_child, merge_keyed, merge_supp, supp_names
from ..operators.relrec import in_order, merge_relrec, related_rows, scan
from .common import keyed

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rename(df, **names):
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])


def _in_study(t: Table, name: str, **more) -> Table:
    """A table of one study and subject."""
    return Table(t.df.withColumns({"STUDYID": F.lit("S"), "USUBJID": F.lit("U"), **more}), name)


def _orders(spark, sf_dir) -> Table:
    return _in_study(keyed(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), "ORDERS")


def _customer(spark, sf_dir) -> Table:
    return _in_study(keyed(spark, sf_dir, "customer", ["c_custkey", "c_name"]), "CUSTOMER")


def _relrec(df: DataFrame, relid, *sides) -> Table:
    """Relationship rows from a table: one relationship a row, with a side (domain, column, value) each."""
    rows = F.array(*[F.struct(F.lit(d).alias("RDOMAIN"), F.lit(c).alias("IDVAR"), v.alias("IDVARVAL"), F.lit(i).alias("i")) for i, (d, c, v) in enumerate(sides)])
    out = df.select(ROW, relid.alias("RELID"), F.explode(rows).alias("x"))
    return Table(out.select(F.lit("S").alias("STUDYID"), F.lit("U").alias("USUBJID"), "RELID", "x.RDOMAIN", "x.IDVAR", "x.IDVARVAL", (F.col(ROW) * len(sides) + F.col("x.i")).alias(ROW)), "RELREC")


def _set_level(spark: SparkSession, *rows) -> Table:
    """Relationship rows (domain, column, value, relid, reltype) as given."""
    data = [(i, "S", "", d, c, v, r, k) for i, (d, c, v, r, k) in enumerate(rows)]
    return Table(spark.createDataFrame(data, f"{ROW} bigint, STUDYID string, USUBJID string, RDOMAIN string, IDVAR string, IDVARVAL string, RELID string, RELTYPE string"), "RELREC")


_TEXT = lambda c: F.col(c).cast("string")


@query("SELECT o_orderkey, c_custkey, c_custkey IS NOT NULL AS matched FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 8 = 0 WHERE o_orderkey % 4 = 0")
def merge_relrec_inner_addressed(spark, sf_dir):
    """Inner keeps the rows that a link addresses, also where its partner does not exist."""
    o, c = _orders(spark, sf_dir), _customer(spark, sf_dir)
    partner = F.when(F.col("o_orderkey") % 8 == 0, F.col("o_custkey")).otherwise(F.lit(-1)).cast("string")
    rel = _relrec(o.df.where("o_orderkey % 4 = 0"), F.concat(F.lit("R"), _TEXT("o_orderkey")), ("ORDERS", "o_orderkey", _TEXT("o_orderkey")), ("CUSTOMER", "c_custkey", partner))
    return _rename(merge_relrec(o, {"CUSTOMER": c}, rel, how="inner").df, o_orderkey="o_orderkey", c_custkey="CUSTOMER.c_custkey", matched="CUSTOMER._matched_")


@query("""SELECT o_orderkey, c_custkey, l_linenumber, c_custkey IS NOT NULL AS c_matched, l_linenumber IS NOT NULL AS l_matched, c_custkey IS NOT NULL OR l_linenumber IS NOT NULL AS matched
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 4 = 0 LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_orderkey % 4 = 0""")
def merge_relrec_two_domains(spark, sf_dir):
    """Per relationship the cross product of its related rows over domains, with a flag a domain and one for all."""
    o, c = _orders(spark, sf_dir), _customer(spark, sf_dir)
    x = _in_study(keyed(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]), "LINEITEM")
    rel = _relrec(o.df.where("o_orderkey % 4 = 0"), F.concat(F.lit("R"), _TEXT("o_orderkey")), ("ORDERS", "o_orderkey", _TEXT("o_orderkey")), ("CUSTOMER", "c_custkey", _TEXT("o_custkey")), ("LINEITEM", "l_orderkey", _TEXT("o_orderkey")))
    m = merge_relrec(o, {"CUSTOMER": c, "LINEITEM": x}, rel).df
    return _rename(m, o_orderkey="o_orderkey", c_custkey="CUSTOMER.c_custkey", l_linenumber="LINEITEM.l_linenumber", c_matched="CUSTOMER._matched_", l_matched="LINEITEM._matched_", matched="RELREC._matched_")


@query("""SELECT 'CUSTOMER' AS domain, count(*) AS n_record, 1 AS n_dataset, true AS mixed FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'LINEITEM', 0, 1, false""")
def merge_relrec_scan(spark, sf_dir):
    """What could be merged: domains by the levels of their links; mixed ones can't."""
    o = _orders(spark, sf_dir)
    rel = _relrec(o.df.where("o_orderkey % 4 = 0"), F.concat(F.lit("R"), _TEXT("o_orderkey")), ("ORDERS", "o_orderkey", _TEXT("o_orderkey")), ("CUSTOMER", "c_custkey", _TEXT("o_custkey")))
    whole = _set_level(spark, ("ORDERS", "o_custkey", "", "W", ""), ("CUSTOMER", "c_custkey", "", "W", ""), ("ORDERS", "o_orderkey", "", "X", ""), ("LINEITEM", "l_orderkey", "", "X", ""))
    both = rel.with_df(rel.df.unionByName(whole.df.drop("RELTYPE").withColumn(ROW, F.col(ROW) - 10)))
    return scan(o, both).select("domain", "n_record", "n_dataset", "mixed")


@query("""SELECT o_orderkey, CAST(NULL AS BIGINT) AS c_custkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT -1, 1, 1""")
def merge_relrec_mixed_domain(spark, sf_dir):
    """Of a domain with links of both levels nothing is merged, and an issue says so (the last row counts them)."""
    o, c = _orders(spark, sf_dir), _customer(spark, sf_dir)
    x = _in_study(keyed(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]), "LINEITEM")
    rel = _set_level(spark, ("ORDERS", "o_custkey", "", "W", ""), ("CUSTOMER", "c_custkey", "", "W", ""), ("ORDERS", "o_orderkey", "1", "V", ""), ("CUSTOMER", "c_custkey", "1", "V", ""), ("ORDERS", "o_orderkey", "", "X", ""), ("LINEITEM", "l_orderkey", "", "X", ""), ("ORDERS", "o_orderkey", "", "Y", ""), ("PART", "p_partkey", "", "Y", ""))
    m = merge_relrec(o, {"CUSTOMER": c, "LINEITEM": x}, rel)
    said = spark.createDataFrame([(-1, sum("both" in i or "of record and of dataset level" in i for i in m.issues), sum("no such dataset" in i for i in m.issues))], "o_orderkey bigint, c_custkey bigint, l_linenumber bigint")
    found = _rename(m.df, o_orderkey="o_orderkey", c_custkey="CUSTOMER.c_custkey", l_linenumber="LINEITEM.l_linenumber")
    return found.select(*[F.col(n).cast("bigint").alias(n) for n in found.columns]).unionByName(said)


@query("""SELECT 'one to many' AS declared, false AS violated UNION ALL SELECT 'many to one', (SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) UNION ALL SELECT 'authored n:1', true""")
def merge_relrec_cardinality(spark, sf_dir):
    """RELTYPE ONE makes a side unique; an authored cardinality is checked instead."""
    o = _orders(spark, sf_dir)
    x = _in_study(keyed(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]), "LINEITEM")
    sides = lambda a, b: _set_level(spark, ("ORDERS", "o_orderkey", "", "X", a), ("LINEITEM", "l_orderkey", "", "X", b))
    out = []
    for name, rel, more in (("one to many", sides("ONE", "MANY"), {}), ("many to one", sides("MANY", "ONE"), {}), ("authored n:1", sides("ONE", "MANY"), {"cardinality": "n:1"})):
        try:
            merge_relrec(o, {"LINEITEM": x}, rel, **more)
            out.append((name, False))
        except CardinalityViolation:
            out.append((name, True))
    return spark.createDataFrame(out, "declared string, violated boolean")


@query("""SELECT *, row_number() OVER (ORDER BY row, related_row) - 1 AS place
FROM (SELECT DISTINCT o_orderkey AS row, l_orderkey * 100 + l_linenumber AS related_row FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""")
def merge_relrec_pair_order(spark, sf_dir):
    """Pairs by primary row, then related row, each once though two relationships make it."""
    from ..model.table import number_rows

    o = _orders(spark, sf_dir)
    x = _in_study(keyed(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]), "LINEITEM")
    rel = _set_level(spark, ("ORDERS", "o_orderkey", "", "X", ""), ("LINEITEM", "l_orderkey", "", "X", ""), ("LINEITEM", "l_orderkey", "", "X", ""))
    pairs = related_rows(o, {"LINEITEM": x}, rel)
    return number_rows(in_order(pairs, ["LINEITEM"]).select("row", "related_row")).select("row", "related_row", F.col(ROW).alias("place"))


@query("""SELECT o_orderkey, c_custkey, c_custkey IS NOT NULL AS unnamed_matched, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON o_orderkey % 25 = n_nationkey""")
def merge_unnamed_partners(spark, sf_dir):
    """Partners without names are named by their place."""
    o = keyed(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    o = o.with_df(o.df.withColumn("nk", F.col("o_orderkey") % 25))
    bare = lambda n, c: Table(keyed(spark, sf_dir, n, c).df)
    m = merge_keyed(o, [Keyed(bare("customer", ["c_custkey"]), [("o_custkey", "c_custkey")]), Keyed(bare("nation", ["n_nationkey", "n_name"]), [("nk", "n_nationkey")])]).df
    return _rename(m, o_orderkey="o_orderkey", c_custkey="part1.c_custkey", unnamed_matched="part1._matched_", n_name="part2.n_name")


@query("""SELECT 'n:1' AS declared, false AS violated UNION ALL SELECT '1:n', (SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))""")
def merge_child_cardinality(spark, sf_dir):
    """Lines point at their orders: a line has one order, an order has several lines."""
    line = keyed(spark, sf_dir, "lineitem", ["l_orderkey"])
    child = line.with_df(line.df.withColumns({"RDOMAIN": F.lit("ORDERS"), "IDVAR": F.lit("O_ORDERKEY"), "IDVARVAL": _TEXT("l_orderkey")}))
    out = []
    for declared in ("n:1", "1:n"):
        try:
            merge_child(child, {"ORDERS": keyed(spark, sf_dir, "orders", ["o_orderkey"])}, cardinality=declared)
            out.append((declared, False))
        except CardinalityViolation:
            out.append((declared, True))
    return spark.createDataFrame(out, "declared string, violated boolean")


def _supp(df: DataFrame, name: str, domain, column: str, value, **qualifiers) -> Table:
    """Record-level supplemental rows from a table: one row for each name of a qualifier and its value."""
    rows = F.array(*[F.struct(F.lit(q).alias("QNAM"), v.cast("string").alias("QVAL"), F.lit(i).alias("i")) for i, (q, v) in enumerate(qualifiers.items())])
    out = df.select(ROW, domain.alias("RDOMAIN"), value.cast("string").alias("IDVARVAL"), F.explode(rows).alias("x"))
    return Table(out.select(F.lit("S").alias("STUDYID"), F.lit("U").alias("USUBJID"), "RDOMAIN", F.lit(column).alias("IDVAR"), "IDVARVAL", "x.QNAM", "x.QVAL", (F.col(ROW) * len(qualifiers) + F.col("x.i")).alias(ROW)), name)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS "SEG", CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS "NAME" FROM customer""")
def merge_supp_domain_key(spark, sf_dir):
    """RDOMAIN is part of the key: rows for another domain qualify nothing here."""
    t = keyed(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    s = _supp(t.df, "SUPPCU", F.when(F.col("c_custkey") % 3 == 0, "ZZ").otherwise("CU"), "c_custkey", F.col("c_custkey"), SEG=F.col("c_mktsegment"), NAME=F.col("c_name"))
    base = _in_study(t.with_df(t.df.select("c_custkey", ROW)), "CU", DOMAIN=F.lit("CU"))
    return merge_supp(base, s).df.select("c_custkey", "SEG", "NAME")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS "Q", 2 AS n_names FROM customer""")
def merge_supp_split(spark, sf_dir):
    """The supplemental rows of a split dataset and of its domain are stacked."""
    t = keyed(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    even, odd = t.df.where("c_custkey % 2 = 0"), t.df.where("c_custkey % 2 = 1")
    names = supp_names("CUSA", "CU")
    parts = {"SUPPCUSA": _supp(even, "SUPPCUSA", F.lit("CU"), "c_custkey", F.col("c_custkey"), Q=F.col("c_mktsegment")), "SUPPCU": _supp(odd, "SUPPCU", F.lit("CU"), "c_custkey", F.col("c_custkey"), Q=F.col("c_name"))}
    base = _in_study(t.with_df(t.df.select("c_custkey", ROW)), "CUSA", DOMAIN=F.lit("CU"))
    return merge_supp(base, *[parts[n] for n in names]).df.select("c_custkey", "Q", F.lit(len(names)).alias("n_names"))


@query("""SELECT o_orderkey, c_mktsegment AS segment, c_custkey IS NOT NULL AS supplied FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def merge_supp_of_partner(spark, sf_dir):
    """Qualifiers of a joined partner come with it, named as its columns."""
    t = keyed(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    s = _supp(t.df, "SUPPCU", F.lit("CU"), "c_custkey", F.col("c_custkey"), SEG=F.col("c_mktsegment"))
    partner = _in_study(t.with_df(t.df.select("c_custkey", ROW)), "CU", DOMAIN=F.lit("CU"))
    m = merge_keyed(keyed(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), [Keyed(partner, [("o_custkey", "c_custkey")], name="CU", supp=(s,))]).df
    return m.select("o_orderkey", F.col("`CU.SEG`").alias("segment"), F.coalesce(F.col("`__sup__CU.SEG`"), F.lit(False)).alias("supplied"))


@query("""SELECT c_custkey, CAST(NULL AS VARCHAR) AS "Seg", c_name AS "NAME", 2 AS n_issues FROM customer""")
def merge_supp_names(spark, sf_dir):
    """A base column stays over a qualifier of its name; names that differ only in case are not supplied."""
    t = keyed(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    s = _supp(t.df, "SUPPCU", F.lit("CU"), "c_custkey", F.col("c_custkey"), Seg=F.col("c_mktsegment"), SEG=F.col("c_name"), NAME=F.col("c_name"), c_custkey=F.lit("x"))
    m = merge_supp(_in_study(t.with_df(t.df.select("c_custkey", ROW)), "CU"), s)
    return m.df.select("c_custkey", "Seg", "NAME", F.lit(len(m.issues)).alias("n_issues"))
