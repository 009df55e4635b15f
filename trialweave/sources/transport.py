"""SAS transport (XPORT version 5) files: hexadecimal floats with missing markers, several members a file."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model.missing import MIS_UNKNOWN
from ..model.table import ROW, Table, encoding_meta, mis
from .normalise import RULES, text_cell

RECORD = 80
#: The format's header records.
_MEMBER = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!"
_OBS = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!"
_NAMESTR = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!"
#: First bytes that mark a missing number.
_MARKERS = frozenset([0x2E, 0x5F, *range(0x41, 0x5B)])


def ibm_to_ieee(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, codes) of rows of eight big-endian bytes; code 0: a value.  A marker's other bytes are zero."""
    b = raw.astype(np.uint64)
    word = np.zeros(len(b), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | b[:, i]
    fraction = (word & np.uint64((1 << 56) - 1)).astype(np.float64)
    value = np.ldexp(fraction, 4 * ((b[:, 0] & np.uint64(0x7F)).astype(np.int64) - 64) - 56)
    value = np.where(b[:, 0] >= 128, -value, value) + 0.0
    empty = ~b[:, 1:].any(1) & (b[:, 0] != 0)
    first = b[:, 0].astype(np.int64)
    known = np.isin(first, list(_MARKERS))
    code = np.where(empty, np.where(known, np.where(first == 0x2E, 64, np.where(first == 0x5F, 60, first)), MIS_UNKNOWN), 0)
    return np.where(code > 0, 0.0, value), code


def ieee_to_ibm(value: float | None, code: int = 64) -> bytes:
    if value is None:
        return bytes([{64: 0x2E, 60: 0x5F}.get(code, code)]) + bytes(7)
    if value == 0:
        return bytes(8)
    m, e = np.frexp(abs(value))
    power = -(-int(e) // 4)
    fraction = int(np.ldexp(m, int(e) - 4 * power + 56))
    return bytes([(128 if value < 0 else 0) | (power + 64)]) + fraction.to_bytes(7, "big")


def members(raw: bytes) -> list[dict]:
    """Members of a transport file: name, label, columns and the bytes of the observations."""
    out, at = [], raw.find(_MEMBER)
    while at >= 0:
        following = raw.find(_MEMBER, at + RECORD)
        end = following if following >= 0 else len(raw)
        size = int(raw[at + 74 : at + 78])
        info = raw[at + 2 * RECORD : at + 4 * RECORD]
        names = raw.find(_NAMESTR, at)
        n = int(raw[names + 54 : names + 58])
        columns, p = [], names + RECORD
        for _ in range(n):
            ntype, _, length, _ = struct.unpack(">hhhh", raw[p : p + 8])
            start = struct.unpack(">l", raw[p + 84 : p + 88])[0]
            fmt = raw[p + 56 : p + 64].decode("latin-1").strip()
            columns.append({"name": raw[p + 8 : p + 16].decode("latin-1").strip(), "label": raw[p + 16 : p + 56].decode("latin-1").strip(), "number": ntype == 1, "length": length, "at": start, "displayFormat": fmt})
            p += size
        obs = raw.find(_OBS, p) + RECORD
        out.append({"name": info[8:16].decode("latin-1").strip(), "label": info[RECORD + 32 : RECORD + 72].decode("latin-1").strip(), "columns": columns, "from": obs, "to": end})
        at = following
    return out


def described(spark: SparkSession, path: str) -> list[dict]:
    """The members of a file, found by the task that reads it; the driver gets no observations."""

    def of(batches):
        for b in batches:
            yield pa.record_batch({"m": pa.array([json.dumps(members(raw)) for raw in b["content"].to_pylist()])})

    return json.loads(spark.read.format("binaryFile").load(path).select("content").mapInArrow(of, "m string").first()["m"])


def read(spark: SparkSession, path: str, member: str | None = None, encoding: str = "latin-1") -> Table:
    """One member of a transport file (the first unless named).  Observations are decoded in slices."""
    found = described(spark, path)
    info = next((m for m in found if member is None or m["name"].lower() == member.lower()), None)
    if info is None:
        raise KeyError(f"{path} has no member {member}")
    columns, width = info["columns"], sum(c["length"] for c in info["columns"])

    def of(batches):
        for b in batches:
            for content in b["content"].to_pylist():
                body = content[info["from"] : info["to"]]
                n = len(body) // width if width else 0
                data = np.frombuffer(body, np.uint8, n * width).reshape(n, width)
                while n and (data[n - 1] == 0x20).all():  # blanks fill the last record
                    n -= 1
                for s in range(0, max(n, 1), 10_000):
                    part = data[s : min(s + 10_000, n)]
                    out = {ROW: pa.array(range(s, s + len(part)), pa.int64())}
                    for c in columns:
                        cell = part[:, c["at"] : c["at"] + c["length"]]
                        if c["number"]:
                            full = np.zeros((len(part), 8), np.uint8)
                            full[:, : c["length"]] = cell
                            value, code = ibm_to_ieee(full)
                            out[c["name"]] = pa.array(value, mask=code > 0)
                            out[mis(c["name"])] = pa.array(code.astype(np.int8), mask=code == 0)
                        else:
                            out[c["name"]] = pa.array([x.tobytes().decode(encoding).rstrip() for x in cell], pa.string())
                    yield pa.record_batch(out)

    schema = f"{ROW} bigint" + "".join(f", `{c['name']}` double, `{mis(c['name'])}` tinyint" if c["number"] else f", `{c['name']}` string" for c in columns)
    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(of, schema)
    rules = RULES["xpt"]
    for c in columns:
        if not c["number"]:
            df = df.withColumn(c["name"], text_cell(F.col(f"`{c['name']}`"), rules))
        df = df.withMetadata(c["name"], {"label": c["label"], "length": c["length"], "displayFormat": c["displayFormat"]})
    return Table(df, info["name"], info["label"], encoding_meta(encoding.upper(), "DEFAULT" if encoding == "latin-1" else "CONFIGURED"))


def library(spark: SparkSession, path: str) -> list[str]:
    """Names of a transport file's members."""
    return [m["name"] for m in described(spark, path)]


def file_of(name: str, label: str, columns: list[dict], rows: list[tuple], encoding: str = "latin-1") -> bytes:
    """A transport file of one member.  columns: name, label, number, length.  Rows are held in memory: for small tables."""
    blank = lambda text, n: text.encode(encoding)[:n].ljust(n)
    stamp = b"01JAN00:00:00:00"
    out = [b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!" + b"0" * 30 + b"  ", b"SAS     SAS     SASLIB  6.06    bsd4.2  " + b" " * 24 + stamp, stamp.ljust(RECORD)]
    out += [_MEMBER + b"0" * 16 + b"01600000000140  ", b"HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!" + b"0" * 30 + b"  "]
    out += [b"SAS     " + blank(name, 8) + b"SASDATA 6.06    bsd4.2  " + b" " * 24 + stamp, stamp + b" " * 16 + blank(label, 40) + b" " * 8]
    out.append(_NAMESTR + b"000000" + f"{len(columns):04d}".encode() + b"0" * 20 + b"  ")
    names, at = b"", 0
    for i, c in enumerate(columns, 1):
        names += struct.pack(">hhhh", 1 if c["number"] else 2, 0, c["length"], i) + blank(c["name"], 8) + blank(c.get("label", ""), 40) + b" " * 8 + struct.pack(">hhh", 0, 0, 0) + b"\0\0" + b" " * 8 + struct.pack(">hhl", 0, 0, at) + bytes(52)
        at += c["length"]
    body = b"".join(ieee_to_ibm(v)[: c["length"]] if c["number"] else blank(v or "", c["length"]) for r in rows for c, v in zip(columns, r, strict=True))
    fill = lambda x: x + b" " * (-len(x) % RECORD)
    return b"".join(out) + fill(names) + _OBS + b"0" * 30 + b"  " + fill(body)
