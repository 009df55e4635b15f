"""Define-XML metadata as tables: datasets, variables, code lists."""

from __future__ import annotations

from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

#: Data types and what they are in a table.
TYPES = {"text": "STRING", "integer": "LONG", "float": "DOUBLE", "date": "STRING", "time": "STRING", "datetime": "STRING", "partialDate": "STRING", "partialTime": "STRING", "partialDatetime": "STRING", "incompleteDatetime": "STRING", "durationDatetime": "STRING"}


@dataclass(frozen=True)
class Define:
    """version; datasets: oid, name, label, repeating, class.  variables: dataset, position, oid, name, label, type,
    data_type, length, format, mandatory, key_sequence, codelist.  terms: codelist, name, code, decode, rank."""

    version: str
    standard: str
    datasets: DataFrame
    variables: DataFrame
    terms: DataFrame


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(e, name: str):
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _all(root, name: str):
    return (e for e in root.iter() if _local(e.tag) == name)


def _text(e, holder: str) -> str:
    """Translated text of a child."""
    for h in e:
        if _local(h.tag) == holder:
            t = next(_all(h, "TranslatedText"), None)
            return ((t.text if t is not None else h.text) or "").strip()
    return ""


def version_of(root) -> str:
    """2.1, 2.0 or 1.0 by the namespace that the document's extensions are of."""
    uris = {e.tag[1:].partition("}")[0] for e in root.iter() if e.tag.startswith("{")} | {k[1:].partition("}")[0] for e in root.iter() for k in e.attrib if k.startswith("{")}
    return next((v for v in ("2.1", "2.0", "1.0") if any(u.endswith(f"def/v{v}") for u in uris)), "")


def parse(spark: SparkSession, text: str) -> Define:
    root = ElementTree.fromstring(text.encode())
    items = {_attr(e, "OID"): e for e in _all(root, "ItemDef")}
    datasets, variables, terms = [], [], []
    for g in _all(root, "ItemGroupDef"):
        oid, name = _attr(g, "OID"), _attr(g, "Name")
        label = _text(g, "Description") or _attr(g, "Label") or ""
        kind = _attr(g, "Class") or next((_attr(c, "Name") for c in g if _local(c.tag) == "Class"), None)
        datasets.append((oid, name, label, _attr(g, "Repeating"), kind))
        for n, r in enumerate((c for c in g if _local(c.tag) == "ItemRef"), 1):
            i = items.get(_attr(r, "ItemOID"))
            if i is None:
                continue
            ref = next((c for c in i if _local(c.tag) == "CodeListRef"), None)
            length, key = _attr(i, "Length"), _attr(r, "KeySequence")
            variables.append((name, int(_attr(r, "OrderNumber") or n), _attr(i, "OID"), _attr(i, "Name"), _text(i, "Description") or _attr(i, "Label") or "", TYPES.get(_attr(i, "DataType"), "STRING"), _attr(i, "DataType"), int(length) if length else None, _attr(i, "DisplayFormat"), _attr(r, "Mandatory") == "Yes", int(key) if key else None, _attr(ref, "CodeListOID") if ref is not None else None))
    for c in _all(root, "CodeList"):
        for n, t in enumerate((x for x in c if _local(x.tag) in ("CodeListItem", "EnumeratedItem")), 1):
            terms.append((_attr(c, "OID"), _attr(c, "Name"), _attr(t, "CodedValue"), _text(t, "Decode") or None, float(_attr(t, "Rank") or n)))
    standards = [f"{_attr(s, 'Name')} {_attr(s, 'Version')}" for s in _all(root, "Standard")]
    meta = next(_all(root, "MetaDataVersion"), None)
    if not standards and meta is not None and _attr(meta, "StandardName"):
        standards = [f"{_attr(meta, 'StandardName')} {_attr(meta, 'StandardVersion')}"]
    return Define(
        version_of(root), standards[0] if standards else "",
        spark.createDataFrame(datasets, "oid string, name string, label string, repeating string, class string"),
        spark.createDataFrame(variables, "dataset string, position int, oid string, name string, label string, type string, data_type string, length int, format string, mandatory boolean, key_sequence int, codelist string"),
        spark.createDataFrame(terms, "codelist string, name string, code string, decode string, rank double"))


def read(spark: SparkSession, path: str) -> Define:
    return parse(spark, spark.read.text(path, wholetext=True).first()[0])


def pruned(text: str, datasets: list[str]) -> str:
    """The document with these datasets only; items and code lists that nothing refers to any more go too."""
    root = ElementTree.fromstring(text.encode())
    keep = {d.upper() for d in datasets}
    parents = {c: p for p in root.iter() for c in p}
    for g in list(_all(root, "ItemGroupDef")):
        if (_attr(g, "Name") or "").upper() not in keep:
            parents[g].remove(g)
    while True:
        used = {v for e in root.iter() for k, v in e.attrib.items() if _local(k).endswith("OID") and _local(k) != "OID"}
        gone = [e for n in ("ItemDef", "CodeList", "ValueListDef", "WhereClauseDef", "MethodDef", "CommentDef") for e in _all(root, n) if _attr(e, "OID") not in used]
        if not gone:
            return ElementTree.tostring(root, encoding="unicode")
        for e in gone:
            parents[e].remove(e)
