"""What shows on larger tables, in small: ties over files, plans that must not multiply rows, text split within records."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from trialweave.model.table import ROW, number_rows
from trialweave.plans.registry import QUERIES
from trialweave.sources import delimited


def _put(folder, name, **columns):
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def test_first_match_ties_by_place(spark, tmp_path):
    """Of lines of one number the first in the table counts, though Spark reads the larger, later file first."""
    _put(tmp_path, "orders", o_orderkey=pa.array(range(500)))
    lines = tmp_path / "lineitem.parquet"
    lines.mkdir()
    for name, n, part in (("a", 500, 1), ("b", 5000, 100_000)):
        _put(lines, name, l_orderkey=pa.array([i % 500 for i in range(n)]), l_linenumber=pa.array([1] * n, pa.int32()), l_partkey=pa.array([part + i for i in range(n)]))
    got = {r["o_orderkey"]: r["first_part"] for r in QUERIES["merge_first_match"](spark, str(tmp_path)).collect()}
    assert got == {i: 1 + i for i in range(500)}


def _rows_of_operators(spark, df):
    """Most rows that any operator of the executed plan made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.finalPhysicalPlan()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            p = p.plan()
        rows = p.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_counted_partners_multiply_no_rows(spark, tmp_path):
    n, m = 3000, 2000
    _put(tmp_path, "customer", c_custkey=pa.array(range(n)), c_nationkey=pa.array([i % 2 if i % 11 else None for i in range(n)], pa.int32()))
    _put(tmp_path, "supplier", s_suppkey=pa.array(range(m)), s_nationkey=pa.array([0] * m, pa.int32()))
    df = QUERIES["merge_drop_missing_keys"](spark, str(tmp_path))
    want = {i: m - len(range(0, m, 5)) if i % 7 and i % 11 and i % 2 == 0 else 0 for i in range(n)}
    assert {r["c_custkey"]: r["kept"] for r in df.collect()} == want
    assert _rows_of_operators(spark, df) <= n + m


def test_approximate_distinct_keeps_one_sketch_a_group(spark, tmp_path):
    """No aggregation by user holds a sketch."""
    _put(tmp_path, "events", event_type=pa.array([None if i % 3 == 0 else str(i % 2) for i in range(3000)]), user_id=pa.array([i % 700 if i % 13 else None for i in range(3000)]))
    df = QUERIES["agg_approximate_distinct"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == [("0", True), ("1", True), (None, True)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct(" in line]
    assert sketches and not any("user_id" in line.split("keys=[")[1].split("]")[0] for line in sketches)


def test_rows_are_numbered_without_python(spark):
    """Numbers run through over tasks, by place or by columns; rows are made once, and not by Python."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(0, 1000, 1, 7).where("id % 3 > 0").mapInArrow(seen, "id bigint").select("id", F.lit(None).alias("nothing"), F.col("id").alias("ID"))
    out = number_rows(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    want = [i for i in range(1000) if i % 3]
    rows = sorted(map(tuple, out.collect()), key=lambda r: r[3])
    assert rows == [(i, None, i, k) for k, i in enumerate(want)] and out.columns == ["id", "nothing", "ID", ROW]
    assert made.value == len(want)
    back = number_rows(spark.range(0, 1000, 1, 7), [F.desc("id")])
    assert sorted((r[ROW], r["id"]) for r in back.collect()) == [(k, 999 - k) for k in range(1000)]
    assert number_rows(spark.range(0)).collect() == []


def test_quoted_line_breaks_over_splits(spark, tmp_path):
    """Splits anywhere, also within quoted cells, give the records of the whole text."""
    rng = random.Random(7)
    ends = ["\n", "\r\n", "\r"]
    cells = ["", "1", ".A", '"x"', 'a"b', '"two\nlines"', '"crlf\r\nin"', '"cr\rin"', '"say ""so"",\n"', '""', '"' + "long\n" * 60 + '"', '"q"r"', "é"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for case in range(4):
            texts = []
            for f in range(2):
                rows = [",".join(rng.choice(cells) for _ in range(3)) for _ in range(40)]
                texts.append("".join(r + (rng.choice(ends) if case % 2 else "\n") for r in ["a,\"b\nb\",c", *rows, '"even\nodd",1,2']))
            texts[1] = texts[1].rstrip("\r\n") + ("" if case % 4 < 2 else '\n1,2,"open\n' + ("" if case % 4 == 2 else "end"))
            where = tmp_path / f"t{case}.csv"
            where.mkdir()
            for f, text in enumerate(texts):
                (where / f"part-{f}.csv").write_bytes(text.encode())
            want = [r for text in texts for r in list(delimited.records(text, ","))[1:]]
            for size in ("90",) if case == 3 else ("400",):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                names, rows, _ = delimited._over_lines(spark, str(where), ",", '"', '"', 10)
                got = sorted(rows.collect(), key=lambda r: r[ROW])
                assert names == ["a", "b\nb", "c"] and [r[ROW] for r in got] == list(range(len(want)))
                assert [[(x["v"], x["q"]) for x in r["c"]] for r in got] == want, (case, size)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_file_of_quoted_line_breaks_is_many_tasks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(200)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        rows = delimited.read(spark, str(tmp_path / "t.csv")).df.select("a", "b", ROW, F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r[ROW], r["a"], r["b"]) for r in rows) == [(i, float(i), "x\ny") for i in range(200)]
    assert len({r["task"] for r in rows}) > 2
