"""What a Spark table adds: aggregates, windows, sets, other joins, sessions, and streams with watermarks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_pricing_summary(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::INT + grouping(o_orderpriority)::INT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), (F.grouping("o_orderstatus").cast("int") + F.grouping("o_orderpriority").cast("int")).alias("level"))


@query("SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def agg_rollup(spark, sf_dir):
    return read(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT c_custkey, rank() OVER w AS place, round(c_acctbal - lag(c_acctbal) OVER w, 2) AS gap FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)")
def window_rank_and_lag(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w).cast("bigint").alias("place"), F.round(F.col("c_acctbal") - F.lag("c_acctbal").over(w), 2).alias("gap"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")
def window_moving_sum(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return read(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("moving"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_orderpriority", "o_orderkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_semi(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(x, "o_orderkey", "left_semi")


@query("""SELECT a.event_id, b.event_id AS before_id FROM events a ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1) b
ON a.user_id = b.user_id AND a.ts > b.ts""")
def join_as_of(spark, sf_dir):
    """Each event with its user's latest earlier purchase, by a running window (no range join)."""
    e = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "bought", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = (F.col("event_type") == "purchase").cast("int")
    both = e.select("user_id", "ts", F.lit(0).alias("bought"), "event_id").unionByName(e.where(bought == 1).select("user_id", "ts", F.lit(1).alias("bought"), "event_id"))
    found = both.withColumn("before_id", F.last(F.when(F.col("bought") == 1, F.col("event_id")), ignorenulls=True).over(order))
    return found.where("bought = 0").select("event_id", "before_id")


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def window_tumbling(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, k""")
def window_sessions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).select("user_id", "started", "n")


@query("SELECT event_type, approx AS about FROM (SELECT event_type, true AS approx FROM events GROUP BY 1)")
def agg_approximate_distinct(spark, sf_dir):
    """approx_count_distinct within 10 % of the exact count."""
    # not in one aggregation: beside a distinct count Spark keeps a sketch for each user
    e = read(spark, sf_dir, "events").select("event_type", "user_id")
    about = e.groupBy(F.col("event_type").alias("t")).agg(F.approx_count_distinct("user_id", 0.02).alias("a"))
    g = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("b")).join(about, F.col("event_type").eqNullSafe(F.col("t")))
    return g.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("about"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    """The same hours from a stream with a watermark, run until its input is used up."""
    from ..streaming.windows import tumbling_counts

    return tumbling_counts(spark, f"{sf_dir}/events.parquet", "ts", "event_type", "1 hour").withColumnRenamed("start", "hour")
