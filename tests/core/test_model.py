"""Tables, keys, merges, sources: worked examples."""

import json
from decimal import ROUND_HALF_EVEN, Decimal
from random import Random

import pytest
from pyspark.sql import functions as F

from trialweave.functions import values as V
from trialweave.functions.dates import category_column, date_text, days, format_category, parse_format
from trialweave.functions.keys import tag, text_tag
from trialweave.model.table import ROW, Table
from trialweave.operators.merge import CardinalityViolation, DegenerateKey, Keyed, KeyTypeClash, merge_child, merge_keyed, merge_relrec, merge_supp
from trialweave.operators.relational import TypeClash, content, equal, union
from trialweave.sources import cdt, dataset_json, delimited, transport


def make(spark, text):
    return next(iter(cdt.tables(spark, text).values()))


AE = "dataset AE\ncol STUDYID type=Char\ncol DOMAIN type=Char\ncol USUBJID type=Char\ncol AESEQ type=Num\ncol AESPID type=Char\n---\nS | AE | 1 | 1 | a\nS | AE | 1 | 2 | b\nS | AE | 2 | 1 | c\n---\n"


def test_keys_are_disjoint(spark):
    a = make(spark, "dataset A\ncol N type=Num\ncol C type=Char\n---\n2 | 2\n. | .\n.A | .A\n0 | \"\"\n---\n")
    rows = a.df.select(tag(a, "N").alias("n"), tag(a, "C").alias("c"), text_tag(a, "N").alias("t")).collect()
    assert [r["n"] for r in rows] == ["N:2.0", "M:64", "M:65", "N:0.0"]
    assert [r["c"] for r in rows] == ["T:2", "M:64", "M:65", "E:"] and rows[0]["t"] == "T:2"
    big = Table(spark.createDataFrame([(0, 2**53), (1, 2**53 + 1), (2, 2)], f"{ROW} bigint, v bigint"))
    dbl = Table(spark.createDataFrame([(0, 2.0**53), (1, 2.0**53 + 2), (2, 2.0)], f"{ROW} bigint, v double"))
    assert [r[0] for r in big.df.select(tag(big, "v")).collect()] == [r[0] if i != 1 else f"L:{2**53 + 1}" for i, r in enumerate(dbl.df.select(tag(dbl, "v")).collect())]


def test_numeric_text_against_decimal(spark):
    rng = Random(1)
    texts = [f"{rng.choice(['', '+', '-'])}{rng.randrange(10**rng.randrange(1, 30))}{rng.choice(['', '.', '.0', f'.{rng.randrange(10**9)}'])}{rng.choice(['', 'E3', 'e-7', 'E+12'])}" for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.numeric_key_text(F.col("t")).alias("k")).collect()
    for r in got:
        assert Decimal(r["k"]) == Decimal(r["t"]) and not r["k"].startswith(("+", "00")) and (Decimal(r["t"]) or r["k"] == "0")
        assert "." not in r["k"] or not r["k"].endswith(("0", "."))


def test_clean_double_against_decimal(spark):
    rng = Random(2)
    vals = [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 12) for _ in range(300)] + [round(rng.uniform(0, 100), 2) * 3 for _ in range(300)] + [0.1 + 0.2, 1e-14, 5.0]
    for r in spark.createDataFrame([(v,) for v in vals], "v double").select("v", V.clean_double(F.col("v")).alias("c")).collect():
        v = r["v"]
        if v == int(v) or abs(v) < 1e-13:
            continue
        d = Decimal(v)
        near = d.quantize(Decimal(1).scaleb(d.adjusted() - 11), ROUND_HALF_EVEN)
        want = float(near) if abs(near - d) <= Decimal(1).scaleb(d.adjusted() - 12) else v
        assert r["c"] == pytest.approx(want, rel=1e-15, abs=0)


def test_keyed_merge(spark):
    ae = make(spark, AE)
    dm = make(spark, "dataset DM\ncol STUDYID type=Char\ncol USUBJID type=Char\ncol AGE type=Num\n---\nS | 1 | 30\nS | 3 | .B\n---\n")
    m = merge_keyed(ae, [Keyed(dm, ["STUDYID", "USUBJID", "NOWHERE"], cardinality="n:1")]).df.orderBy(ROW).collect()
    assert [(r["DM.AGE"], r["DM._matched_"]) for r in m] == [(30.0, True), (30.0, True), (None, False)]
    assert merge_keyed(ae, [Keyed(dm, ["USUBJID"], how="inner")]).df.count() == 2
    with pytest.raises(CardinalityViolation, match="rows 1 and 2"):
        merge_keyed(ae, [Keyed(dm, ["USUBJID"], cardinality="1:1")])
    with pytest.raises(DegenerateKey):
        merge_keyed(ae, [Keyed(dm, ["AGE"])])
    number = make(spark, "dataset N\ncol USUBJID type=Num\ncol X type=Char\n---\n1 | one\n---\n")
    with pytest.raises(KeyTypeClash):
        merge_keyed(ae, [Keyed(number, ["USUBJID"])])
    assert merge_keyed(ae, [Keyed(number, ["USUBJID"], as_text=True, how="inner")]).df.count() == 2


def test_missing_keys_join_by_marker(spark):
    a = make(spark, "dataset A\ncol K type=Num\n---\n.\n.A\n1\n---\n")
    b = make(spark, "dataset B\ncol K type=Num\ncol V type=Char\n---\n. | dot\n1 | one\n---\n")
    got = [r["B.V"] for r in merge_keyed(a, [Keyed(b, ["K"])]).df.orderBy(ROW).collect()]
    assert got == ["dot", None, "one"]
    assert [r["B.V"] for r in merge_keyed(a, [Keyed(b, ["K"], keep_missings=False)]).df.orderBy(ROW).collect()] == [None, None, "one"]


def test_supp(spark):
    ae = make(spark, AE)
    supp = make(spark, "dataset SUPPAE\ncol STUDYID type=Char\ncol RDOMAIN type=Char\ncol USUBJID type=Char\ncol IDVAR type=Char\ncol IDVARVAL type=Char\ncol QNAM type=Char\ncol QVAL type=Char\n---\nS | AE | 1 | AESEQ | 1.0 | Q1 | x\nS | AE | 1 | AESEQ | 2 | Q1 | y\nS | AE | 1 | AESEQ | 02 | Q1 | z\nS | AE | 2 | \"\" | \"\" | Q2 | subj\nS | AE | 2 | NONE | 1 | Q1 | lost\nS | AE | 1 | \"\" | \"\" | AETERM | s\nS | AE | 1 | AESEQ | 1 | AETERM | r\n---\n")
    m = merge_supp(ae, supp)
    rows = m.df.orderBy(ROW).collect()
    assert [(r["Q1"], r["__sup__Q1"], r["__dup__Q1"]) for r in rows] == [("x", True, False), (None, False, True), (None, False, False)]
    assert [r["Q2"] for r in rows] == [None, None, "subj"] and [r["AETERM"] for r in rows] == [None, None, None]
    assert any("NONE" in i for i in m.issues)


def test_child_and_relrec(spark):
    ae = make(spark, AE)
    co = make(spark, "dataset CO\ncol STUDYID type=Char\ncol RDOMAIN type=Char\ncol USUBJID type=Char\ncol IDVAR type=Char\ncol IDVARVAL type=Char\ncol COVAL type=Char\n---\nS | AE | 1 | AESEQ | 02 | two\nS | AE | 2 | AESPID | c | cee\nS | XX | 1 | A | 1 | none\n---\n")
    m = merge_child(co, {"AE": ae})
    assert [r["AE.AESPID"] for r in m.df.orderBy(ROW).collect()] == ["b", "c", None] and "XX: no such dataset" in m.issues
    cm = make(spark, "dataset CM\ncol STUDYID type=Char\ncol USUBJID type=Char\ncol CMSEQ type=Num\ncol CMTRT type=Char\n---\nS | 1 | 7 | asp\nS | 1 | 8 | ibu\n---\n")
    rel = make(spark, "dataset RELREC\ncol STUDYID type=Char\ncol RDOMAIN type=Char\ncol USUBJID type=Char\ncol IDVAR type=Char\ncol IDVARVAL type=Char\ncol RELID type=Char\n---\nS | AE | 1 | AESEQ | 1 | R1\nS | CM | 1 | CMSEQ | 7 | R1\nS | CM | 1 | CMSEQ | 8 | R1\n---\n")
    got = merge_relrec(ae, {"CM": cm}, rel).df.orderBy(ROW, "`CM.CMSEQ`").collect()
    assert [(r["AESPID"], r["CM.CMTRT"], r["RELREC._matched_"]) for r in got] == [("a", "asp", True), ("a", "ibu", True), ("b", None, False), ("c", None, False)]
    assert merge_relrec(ae, {"CM": cm}, rel, how="inner").df.count() == 2


def test_pointers_beyond_the_name_limit(spark, monkeypatch):
    from trialweave.operators import merge

    monkeypatch.setattr(merge, "MAX_NAMES", 1)
    ae = make(spark, AE)
    head = "col STUDYID type=Char\ncol RDOMAIN type=Char\ncol USUBJID type=Char\ncol IDVAR type=Char\ncol IDVARVAL type=Char\n"
    co = make(spark, f"dataset CO\n{head}---\nS | AE | 1 | AESEQ | 02\nS | AE | 2 | AESPID | c\n---\n")
    assert [r["AE.AESPID"] for r in merge_child(co, {"AE": ae}).df.orderBy(ROW).collect()] == ["b", "c"]
    supp = make(spark, f"dataset SUPPAE\n{head}col QNAM type=Char\ncol QVAL type=Char\n---\nS | AE | 1 | AESEQ | 2 | Q | y\nS | AE | 2 | AESPID | c | Q | z\n---\n")
    assert [r["Q"] for r in merge_supp(ae, supp).df.orderBy(ROW).collect()] == [None, "y", "z"]
    lost = make(spark, f"dataset CO\n{head}---\nS | AE | 1 | NONE1 | 02\nS | AE | 2 | NONE2 | c\n---\n")
    with pytest.raises(merge.MergeError, match="more than 1"):
        merge_child(lost, {"AE": ae})


def test_relrec_inner_keeps_addressed_rows(spark):
    ae = make(spark, AE)
    cm = make(spark, "dataset CM\ncol STUDYID type=Char\ncol USUBJID type=Char\ncol CMSEQ type=Num\n---\nS | 1 | 7\n---\n")
    rel = make(spark, "dataset RELREC\ncol STUDYID type=Char\ncol RDOMAIN type=Char\ncol USUBJID type=Char\ncol IDVAR type=Char\ncol IDVARVAL type=Char\ncol RELID type=Char\n---\nS | AE | 1 | AESEQ | 1 | R1\nS | CM | 1 | CMSEQ | 7 | R1\nS | AE | 1 | AESEQ | 2 | R2\nS | CM | 1 | CMSEQ | 99 | R2\n---\n")
    got = merge_relrec(ae, {"CM": cm}, rel, how="inner").df.orderBy(ROW).collect()
    assert [(r["AESPID"], r["CM.CMSEQ"], r["RELREC._matched_"]) for r in got] == [("a", 7.0, True), ("b", None, False)]


def test_union_and_content(spark):
    a = make(spark, "dataset A\ncol X type=Num\ncol Y type=Char\n---\n1 | p\n---\n")
    b = make(spark, "dataset B\ncol y type=Char\ncol Z type=Num\n---\nq | .C\n---\n")
    u = union(a, b).df.orderBy(ROW).collect()
    assert [(r["X"], r["Y"], r["Z"], r["Z__mis"]) for r in u] == [(1.0, "p", None, None), (None, "q", None, 67)]
    with pytest.raises(TypeClash):
        union(a, make(spark, "dataset B\ncol X type=Char\n---\nt\n---\n"))
    assert equal(a, a) and not equal(a, b)
    assert {r["column"]: (r["status"], r["uniform"]) for r in content(b).collect()} == {"y": ("FILLED", True), "Z": ("MISSING", True)}


def test_cdt_round_trip(spark):
    text = 'dataset T label="A table"\ncol C type=Char label="see"\ncol N type=Num\ncol D type=Date\ncol S type=DateTime\ncol H type=Time\n---\n"a | ""b""" | 1.5 | 2024-02-29 | 2024-02-29T12:30:00 | 01:02:03\n"." | .Z | . | ._ | .\n"" | -3 | 1959-12-31 | 1960-01-01T00:00:00 | 23:59:59\n---\n'
    t = make(spark, text)
    assert cdt.to_text(t) == text
    doc = "# note\n" + text + "\n# end\n"
    changed = t.with_df(t.df.where(f"{ROW} = 1"))
    assert cdt.with_dataset(doc, changed).startswith("# note\ndataset T") and cdt.with_dataset(doc, changed).endswith("# end\n")
    for bad in ("dataset T\ncol N type=Num\n---\nx\n---\n", "dataset T\ncol N type=Odd\n", "dataset T\ncol N type=Num\n---\n1 | 2\n---\n", "dataset T\ncol N type=Num\n---\n1\n"):
        with pytest.raises(cdt.CdtError):
            cdt.parse(bad)


def test_delimited(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('a;A;;n;q\n1; x ;"";1,5;"1"\n.;".";.B;.A;"2"\n2;"say ""hi""\nthere";;3e1;"3"\n')
    t = delimited.read(spark, str(f))
    assert t.columns == ["a", "A_2", "V3", "n", "q"]
    rows = t.df.orderBy(ROW).collect()
    assert [r["a"] for r in rows] == [1.0, None, 2.0] and [r["A_2"] for r in rows] == [" x", ".", 'say "hi"\nthere']
    assert [r["n"] for r in rows] == ["1,5", None, "3e1"] and rows[1]["n__mis"] == 65 and [r["q"] for r in rows] == ["1", "2", "3"]
    assert rows[1]["V3"] is None and rows[1]["V3__mis"] == 66


def test_dataset_json(spark, tmp_path):
    head = {"datasetJSONVersion": "1.1.0", "name": "T", "label": "L", "records": 3, "columns": [{"name": "C", "dataType": "string", "label": "c"}, {"name": "N", "dataType": "double"}, {"name": "B", "dataType": "boolean"}, {"name": "T", "dataType": "string", "targetDataType": "decimal"}]}
    rows = [["x", 1.5, True, "1,234.5"], [None, None, None, ""], ["", 2, False, "bad"]]
    (tmp_path / "t.json").write_text(json.dumps({**head, "rows": rows}))
    (tmp_path / "t.ndjson").write_text("\n".join(map(json.dumps, [head, *rows])))
    for name in ("t.json", "t.ndjson"):
        got = dataset_json.read(spark, str(tmp_path / name)).df.orderBy(ROW).collect()
        assert [(r["C"], r["N"], r["B"], r["T"]) for r in got] == [("x", 1.5, True, 1234.5), (None, None, None, None), ("", 2.0, False, None)]
        assert got[2]["T__mis"] == 102
    (tmp_path / "u.json").write_text(json.dumps({**head, "records": 5, "rows": rows}))
    with pytest.raises(dataset_json.RowCountMismatch):
        dataset_json.read(spark, str(tmp_path / "u.json"))


def test_hexadecimal_floats():
    import numpy as np

    rng = Random(3)
    vals = [0.0, 1.0, -1.0, 0.1, 1e10, -3.5e-7, 123456.789] + [rng.uniform(-1e6, 1e6) for _ in range(200)]
    raw = np.frombuffer(b"".join(transport.ieee_to_ibm(v) for v in vals) + transport.ieee_to_ibm(None) + transport.ieee_to_ibm(None, 66), np.uint8).reshape(-1, 8)
    got, code = transport.ibm_to_ieee(raw)
    assert np.allclose(got[:-2], vals, rtol=1e-15) and list(code[-2:]) == [64, 66] and not code[:-2].any()


def test_dates_and_formats(spark):
    d = spark.createDataFrame([("1960-01-01",), ("2024-02-29",)], "s string").select(days(F.col("s")).alias("d"))
    assert [(r["d"], r["t"]) for r in d.select("d", date_text(F.col("d")).alias("t")).collect()] == [(0.0, "1960-01-01"), (23435.0, "2024-02-29")]
    assert [format_category(f) for f in ("DATE9.", "E8601DT19.3", "TIME5.", "BEST12.", "$20.")] == ["DATE_SAS", "DATETIME_SAS", "TIME_SAS", "OTHER", "OTHER"]
    assert parse_format("BEST12.4").decimals == 4 and parse_format("$200.").character
    got = spark.createDataFrame([("DATE9.",), ("E8601DA10.",)], "f string").select(category_column(F.col("f"))).collect()
    assert {r[0] for r in got} == {"DATE_SAS"}
