"""Spreadsheets, metadata documents, transport files and the catalog."""

import zipfile

import pytest

from trialweave.model.table import ROW
from trialweave.sources import catalog, define, normalise, spreadsheet, transport

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path):
    sheet = f'<worksheet {M}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" s="1"><v>21916</v></c></row><row r="3"><c r="A3" t="e"><v>#N/A</v></c><c r="C3" s="1"><v>21917.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {M} xmlns:r="{R}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {M}><si><t>num</t></si><si><t>x</t></si><si><r><t>he</t></r><r><t>llo </t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {M}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_spreadsheet(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    t = catalog.read(spark, f"{tmp_path}/b.xlsx#One")
    assert t.columns == ["num", "x", "x_2"] and spreadsheet.library(spark, f"{tmp_path}/b.xlsx") == ["One"]
    rows = t.df.orderBy(ROW).collect()
    assert [(r["num"], r["num__mis"], r["x"], r["x_2"]) for r in rows] == [(1.5, None, "hello", 0.0), (None, 102, "", 129600.0)]
    assert t.df.schema["x_2"].metadata["displayFormat"] == "E8601DT."


DEFINE = """<ODM xmlns="http://www.cdisc.org/ns/odm/v1.3" xmlns:def="http://www.cdisc.org/ns/def/v2.1"><Study OID="S"><MetaDataVersion OID="M"><def:Standards><def:Standard OID="ST" Name="SDTMIG" Version="3.4"/></def:Standards>
<ItemGroupDef OID="IG.DM" Name="DM" Repeating="No"><Description><TranslatedText>Demographics</TranslatedText></Description><ItemRef ItemOID="IT.SEX" OrderNumber="1" Mandatory="Yes" KeySequence="1"/><def:Class Name="SPECIAL PURPOSE"/></ItemGroupDef>
<ItemGroupDef OID="IG.AE" Name="AE" Repeating="Yes"><ItemRef ItemOID="IT.SEQ" Mandatory="No"/></ItemGroupDef>
<ItemDef OID="IT.SEX" Name="SEX" DataType="text" Length="1"><Description><TranslatedText>Sex</TranslatedText></Description><CodeListRef CodeListOID="CL.SEX"/></ItemDef><ItemDef OID="IT.SEQ" Name="AESEQ" DataType="integer"/>
<CodeList OID="CL.SEX" Name="Sex" DataType="text"><CodeListItem CodedValue="F"><Decode><TranslatedText>Female</TranslatedText></Decode></CodeListItem><EnumeratedItem CodedValue="U"/></CodeList></MetaDataVersion></Study></ODM>"""


def test_define(spark):
    d = define.parse(spark, DEFINE)
    assert (d.version, d.standard) == ("2.1", "SDTMIG 3.4")
    assert {(r["name"], r["label"], r["class"]) for r in d.datasets.collect()} == {("DM", "Demographics", "SPECIAL PURPOSE"), ("AE", "", None)}
    sex = d.variables.where("name = 'SEX'").first()
    assert (sex["type"], sex["length"], sex["mandatory"], sex["key_sequence"], sex["codelist"]) == ("STRING", 1, True, 1, "CL.SEX")
    assert {(r["code"], r["decode"]) for r in d.terms.collect()} == {("F", "Female"), ("U", None)}
    cut = define.parse(spark, define.pruned(DEFINE, ["ae"]))
    assert [r["name"] for r in cut.variables.collect()] == ["AESEQ"] and cut.terms.count() == 0


def xport(name, columns, rows):
    pad = lambda b: b + b" " * (-len(b) % 80)
    out = pad(b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!" + b"0" * 30) + b" " * 160
    out += pad(b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000140")
    out += pad(b"HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!" + b"0" * 30)
    out += pad(b"SAS     " + name.ljust(8).encode()) + pad(b" " * 32 + b"A label")
    out += pad(b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000" + f"{len(columns):04d}".encode() + b"0" * 20)
    body, at = b"", 0
    for i, (c, number, length) in enumerate(columns, 1):
        body += (1 if number else 2).to_bytes(2, "big") + b"\0\0" + length.to_bytes(2, "big") + i.to_bytes(2, "big") + c.ljust(8).encode() + b"label".ljust(40) + b" " * 8 + bytes(20) + at.to_bytes(4, "big") + bytes(52)
        at += length
    out += pad(body) + pad(b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!" + b"0" * 30)
    return out + pad(b"".join(v if isinstance(v, bytes) else v.encode() for r in rows for v in r))


def test_transport(spark, tmp_path):
    num = transport.ieee_to_ibm
    (tmp_path / "d.xpt").write_bytes(xport("DM", [("ID", False, 4), ("V", True, 8)], [("a   ", num(1.5)), ("    ", num(None, 65)), ("b   ", num(None)), ("c   ", num(-0.1))]))
    t = catalog.read(spark, f"{tmp_path}/d.xpt#DM")
    rows = t.df.orderBy(ROW).collect()
    assert [(r["ID"], r["V"], r["V__mis"]) for r in rows] == [("a", 1.5, None), ("", None, 65), ("b", None, 64), ("c", -0.1, None)]
    assert (t.name, t.label, transport.library(spark, f"{tmp_path}/d.xpt")) == ("DM", "A label", ["DM"])


def test_parquet_rules_and_catalog(spark, tmp_path):
    df = spark.sql("SELECT date'1960-01-02' AS d, timestamp'1960-01-01 00:01:00' AS t, cast(1.25 AS decimal(10,2)) AS m, double('NaN') AS x, double('Infinity') AS y, -0.0D AS z, 7 AS i, array('a', null) AS l, 'q  ' AS s, true AS b")
    df.write.parquet(f"{tmp_path}/p.parquet")
    r = catalog.read(spark, f"{tmp_path}/p.parquet").df.first()
    assert (r["d"], r["t"], r["m"], r["x"], r["x__mis"], r["y"], r["y__mis"], str(r["z"]), r["i"], r["l"], r["s"], r["b"]) == (1.0, 60.0, 1.25, None, 64, None, 102, "0.0", 7, "a, ", "q", True)
    lossy = spark.sql("SELECT cast('12345678901234567890.12345' AS decimal(30,5)) AS m")
    with pytest.raises(Exception, match="not exact"):
        normalise.parquet(lossy).collect()
    assert [catalog.format_of(x) for x in ("a.csv", "b.NDJSON", "c.xpt#M", "d.cdt", "e.bin")] == ["csv", "dsj", "xpt", "cdt", None]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "AE.cdt").write_text("dataset AE\n")
    assert list(catalog.folder(spark, f"{tmp_path}/m")) == ["AE"]
