"""SAS7BDAT files: pages of fixed size, dealt to tasks; values of truncated width, missing markers, compressed rows.

One task finds the file's pages and their first rows, and what describes its columns; the pages are decoded by as many
tasks as there are slices of ``SLICE`` pages.  Uncompressed pages are decoded by columns, compressed rows one by one.
Files of more than 2 GB cannot be read, since Spark's binary reader holds a file in one value.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model.missing import MIS, MIS_ERROR, MIS_UNKNOWN
from ..model.table import ROW, Table, encoding_meta, mis
from .normalise import RULES, text_cell

#: Pages that are decoded by one task together.
SLICE = 64
#: The first bytes of a file, signatures of subheaders, names of compressions, codes of encodings.
MAGIC = bytes.fromhex("000000000000000000000000c2ea8160b31411cfbd92080009c7318c181f1011")
ROW_SIZE, COLUMN_SIZE, COLUMN_TEXT, COLUMN_NAME, COLUMN_ATTRIBUTES, FORMAT_LABEL = 0xF7F7F7F7, 0xF6F6F6F6, 0xFFFFFFFD, 0xFFFFFFFF, 0xFFFFFFFC, 0xFFFFFBFE
RLE, RDC = b"SASYZCRL", b"SASYZCR2"
ENCODINGS = {20: "utf-8", 28: "ascii", 29: "iso8859-1", 30: "iso8859-2", 31: "iso8859-3", 32: "iso8859-4", 33: "iso8859-5", 34: "iso8859-6", 35: "iso8859-7", 36: "iso8859-8", 37: "iso8859-9", 40: "iso8859-15", 43: "cp437", 44: "cp850", 45: "cp852", 51: "cp866", 60: "cp1250", 61: "cp1251", 62: "cp1252", 63: "cp1253", 64: "cp1254", 65: "cp1255", 66: "cp1256", 67: "cp1257", 68: "cp1258", 119: "euc_tw", 123: "big5", 125: "gb2312", 134: "euc_jp", 138: "shift_jis", 140: "euc_kr"}
#: Bits of a page's type: rows, rows beside metadata, some rows deleted.
_DATA, _MIX, _DELETED = 0x100, 0x200, 0x80


class Sas7bdatError(ValueError):
    """A file that is not of the format."""


class Layout:
    """Where things stand in a file: word size, byte order, page size."""

    def __init__(self, raw: bytes):
        if raw[:32] != MAGIC:
            raise Sas7bdatError("not a SAS7BDAT file")
        self.wide = raw[32] == 0x33
        self.word = 8 if self.wide else 4
        self.order = "<" if raw[37] == 1 else ">"
        shift = 4 if raw[35] == 0x33 else 0
        self.header, self.page = struct.unpack_from(f"{self.order}ii", raw, 196 + shift)
        self.at = 32 if self.wide else 16  # of a page's type
        self.encoding = ENCODINGS.get(raw[70])
        self.name = raw[92:156].decode("latin-1").rstrip("\0 ")

    def int(self, raw, at: int) -> int:
        return struct.unpack_from(self.order + ("q" if self.wide else "i"), raw, at)[0]

    def short(self, raw, at: int) -> int:
        return struct.unpack_from(f"{self.order}H", raw, at)[0]

    def pages(self, raw: bytes):
        for at in range(self.header, len(raw) - self.page + 1, self.page):
            yield raw[at : at + self.page]

    def kind(self, page) -> tuple[int, int, int]:
        """(type, blocks, subheaders) of a page."""
        return self.short(page, self.at), self.short(page, self.at + 2), self.short(page, self.at + 4)

    def subheaders(self, page):
        """(offset, length, compression, type) of the pointers of a page."""
        step = 3 * self.word
        for i in range(self.kind(page)[2]):
            p = self.at + 8 + i * step
            yield self.int(page, p), self.int(page, p + self.word), page[p + 2 * self.word], page[p + 2 * self.word + 1]


def _signature(lay: Layout, page, at: int) -> int:
    return lay.int(page, at) & 0xFFFFFFFF


def describe(raw: bytes) -> dict:
    """Columns, row length and count, compression, encoding and name of a file."""
    lay = Layout(raw)
    out = {"rows": 0, "length": 0, "mix": 0, "columns": [], "compression": "", "name": lay.name, "encoding": lay.encoding, "label": ""}
    texts, names, attributes, formats = [], [], [], []
    w = lay.word
    for page in lay.pages(raw):
        kind = lay.kind(page)[0]
        if kind & _DATA and not kind & _MIX:
            continue
        for at, length, compression, _ in lay.subheaders(page):
            if not length or compression == 1:
                continue
            sign = _signature(lay, page, at)
            if sign == ROW_SIZE:
                out |= {"length": lay.int(page, at + 5 * w), "rows": lay.int(page, at + 6 * w), "mix": lay.int(page, at + 15 * w)}
            elif sign == COLUMN_TEXT:
                texts.append(page[at + w : at + w + lay.short(page, at + w)])
                if len(texts) == 1:
                    out["compression"] = next((c.decode() for c in (RLE, RDC) if c in texts[0]), "")
            elif sign == COLUMN_NAME:
                for i in range((length - 2 * w - 12) // 8):
                    p = at + w + 8 + 8 * i
                    names.append([lay.short(page, p), lay.short(page, p + 2), lay.short(page, p + 4)])
            elif sign == COLUMN_ATTRIBUTES:
                for i in range((length - 2 * w - 12) // (w + 8)):
                    p = at + w + 8 + (w + 8) * i
                    attributes.append([lay.int(page, p), struct.unpack_from(f"{lay.order}i", page, p + w)[0], page[p + w + 6]])
            elif sign == FORMAT_LABEL:
                p = at + 3 * w + 22
                formats.append([[lay.short(page, p + 2 * i) for i in range(3)], [lay.short(page, p + 6 + 2 * i) for i in range(3)]])
    code = lay.encoding or "latin-1"
    text = lambda x: texts[min(x[0], len(texts) - 1)][x[1] : x[1] + x[2]].decode(code, "replace").strip() if texts and x[2] else ""
    for i, (name, (at, length, kind)) in enumerate(zip(names, attributes, strict=False)):
        f = formats[i] if i < len(formats) else [[0, 0, 0], [0, 0, 0]]
        out["columns"].append({"name": text(name), "at": at, "length": length, "number": kind == 1, "displayFormat": text(f[0]), "label": text(f[1])})
    return out


def _deleted(lay: Layout, page, meta: dict) -> set[int]:
    """Places of the deleted rows of a page, by the bit map behind its rows."""
    kind, blocks, subs = lay.kind(page)
    if not kind & _DELETED:
        return set()
    pointer = struct.unpack_from(f"{lay.order}i", page, 24 if lay.wide else 12)[0]
    step = 3 * lay.word
    at = lay.at + pointer + (lay.at + 8 + subs * step) % 8 + subs * step + (blocks - subs) * meta["length"]
    bits = np.unpackbits(np.frombuffer(page, np.uint8, -(-(blocks - subs) // 8), at))
    return set(np.flatnonzero(bits[: blocks - subs]).tolist())


def _rows_at(lay: Layout, page, meta: dict) -> tuple[int, int]:
    """(place of the first row, rows) of the uncompressed rows of a page."""
    kind, blocks, subs = lay.kind(page)
    if kind & _MIX:
        at = lay.at + 8 + subs * 3 * lay.word
        return at + at % 8, min(meta["rows"], meta["mix"], blocks - subs)
    return lay.at + 8, blocks if kind & _DATA else 0


def _packed_rows(lay: Layout, page, meta: dict) -> list[tuple[int, int]]:
    """(place, length) of the rows that stand in subheaders of a compressed file's page."""
    if not meta["compression"] or lay.kind(page)[0] & _DATA:
        return []
    return [(at, n) for at, n, compression, kind in lay.subheaders(page) if n and compression in (0, 4) and kind == 1]


def unpack_rle(raw: bytes, length: int) -> bytes:
    """A row by run lengths."""
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < length:
        command, low = raw[i] >> 4, raw[i] & 15
        i += 1
        if command in (0, 1):
            n = raw[i] + 64 + 256 * low + (4096 if command else 0)
            out += raw[i + 1 : i + 1 + n]
            i += 1 + n
        elif command in (2, 8, 9, 10, 11):
            n = low + {2: 96, 8: 1, 9: 17, 10: 33, 11: 49}[command]
            out += raw[i : i + n]
            i += n
        elif command == 4:
            out += bytes([raw[i + 1]]) * (raw[i] + 18 + 256 * low)
            i += 2
        elif command in (5, 6, 7):
            out += {5: b"@", 6: b" ", 7: b"\0"}[command] * (raw[i] + 17 + 256 * low)
            i += 1
        elif command == 12:
            out += bytes([raw[i]]) * (low + 3)
            i += 1
        elif command in (13, 14, 15):
            out += {13: b"@", 14: b" ", 15: b"\0"}[command] * (low + 2)
        else:
            raise Sas7bdatError(f"run of kind {command}")
    return bytes(out).ljust(length, b"\0")[:length]


def unpack_rdc(raw: bytes, length: int) -> bytes:
    """A row by runs and back references."""
    out, i, bits, mask = bytearray(), 0, 0, 0
    while i < len(raw) and len(out) < length:
        mask >>= 1
        if not mask:
            bits, mask, i = raw[i] << 8 | raw[i + 1], 0x8000, i + 2
        if not bits & mask:
            out.append(raw[i])
            i += 1
            continue
        command, n = raw[i] >> 4, raw[i] & 15
        i += 1
        if command == 0:
            out += bytes([raw[i]]) * (n + 3)
            i += 1
        elif command == 1:
            out += bytes([raw[i + 1]]) * (n + 19 + (raw[i] << 4))
            i += 2
        else:
            back = n + 3 + (raw[i] << 4)
            i += 1
            if command == 2:
                command, i = raw[i] + 16, i + 1
            for _ in range(command):
                out.append(out[-back])
    return bytes(out).ljust(length, b"\0")[:length]


def numbers(cells: np.ndarray, order: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, codes) of rows of one to eight bytes, the first of a double's (the last in little-endian order); code 0: a value."""
    full = np.zeros((len(cells), 8), np.uint8)
    if order == "<":
        full[:, 8 - cells.shape[1] :] = cells
    else:
        full[:, : cells.shape[1]] = cells
    bits = full.view("<u8" if order == "<" else ">u8").ravel().astype(np.uint64)
    value = bits.view(np.float64)
    marker = (~(bits >> np.uint64(40))).astype(np.int64) & 0x7F  # 0 is '_', 1 is '.', from 2 on letters
    code = np.select([marker == 0, marker == 1, marker < 28], [60, 64, marker + 63], MIS_UNKNOWN)
    bare = (bits & np.uint64((1 << 51) - 1)) == 0
    code = np.where(np.isnan(value), np.where(bare, MIS, code), np.where(np.isinf(value), MIS_ERROR, 0))
    return np.where(code > 0, 0.0, value) + 0.0, code


def _page_rows(lay: Layout, page, meta: dict) -> np.ndarray:
    """The rows of a page that are not deleted, as an array of bytes."""
    length = meta["length"]
    at, n = _rows_at(lay, page, meta)
    if packed := _packed_rows(lay, page, meta):
        unpack = unpack_rle if meta["compression"] == RLE.decode() else unpack_rdc
        rows = [page[a : a + m] if m == length else unpack(page[a : a + m], length) for a, m in packed]
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), length)
    rows = np.frombuffer(page, np.uint8, n * length, at).reshape(n, length)
    gone = _deleted(lay, page, meta)
    return rows[[i for i in range(n) if i not in gone]] if gone else rows


def described(spark: SparkSession, path: str) -> dict:
    """What describes a file, found by the task that reads it."""

    def of(batches):
        for b in batches:
            yield pa.record_batch({"m": pa.array([json.dumps(describe(raw)) for raw in b["content"].to_pylist()])})

    return json.loads(spark.read.format("binaryFile").load(path).select("content").mapInArrow(of, "m string").first()["m"])


def read(spark: SparkSession, path: str, encoding: str | None = None) -> Table:
    """A SAS7BDAT file as a table; deleted rows are left out.  ``encoding`` counts if the file names none that is known."""
    meta = described(spark, path)
    columns, code = meta["columns"], meta["encoding"] or encoding or "cp1252"

    def pages(batches):
        for b in batches:
            for raw in b["content"].to_pylist():
                lay, left, at = Layout(raw), meta["rows"], 0  # rows to come, deleted ones too; rows found
                for i, page in enumerate(lay.pages(raw)):
                    packed = _packed_rows(lay, page, meta)
                    slots = min(len(packed) or _rows_at(lay, page, meta)[1], left)
                    n = slots - (0 if packed else len([x for x in _deleted(lay, page, meta) if x < slots]))
                    if n:
                        yield pa.record_batch({"slice": pa.array([i // SLICE], pa.int32()), "first": pa.array([at], pa.int64()), "n": pa.array([n], pa.int32()), "head": pa.array([raw[:288]]), "page": pa.array([page])})
                    left, at = left - slots, at + n

    def decoded(batches):
        for b in batches:
            for first, n, head, page in zip(*(b[c].to_pylist() for c in ("first", "n", "head", "page")), strict=True):
                lay = Layout(head)
                rows = _page_rows(lay, page, meta)[:n]
                out = {ROW: pa.array(range(first, first + len(rows)), pa.int64())}
                for c in columns:
                    cell = rows[:, c["at"] : c["at"] + c["length"]]
                    if c["number"]:
                        value, marker = numbers(cell, lay.order)
                        out[c["name"]] = pa.array(value, mask=marker > 0)
                        out[mis(c["name"])] = pa.array(marker.astype(np.int8), mask=marker == 0)
                    else:
                        out[c["name"]] = pa.array([x.tobytes().decode(code, "replace").rstrip("\0 ") for x in cell], pa.string())
                yield pa.record_batch(out)

    schema = f"{ROW} bigint" + "".join(f", `{c['name']}` double, `{mis(c['name'])}` tinyint" if c["number"] else f", `{c['name']}` string" for c in columns)
    dealt = spark.read.format("binaryFile").load(path).select("content").mapInArrow(pages, "slice int, first bigint, n int, head binary, page binary").repartition("slice")
    df = dealt.mapInArrow(decoded, schema)
    for c in columns:
        if not c["number"]:
            df = df.withColumn(c["name"], text_cell(F.col(f"`{c['name']}`"), RULES["sas7bdat"]))
        df = df.withMetadata(c["name"], {k: c[k] for k in ("label", "length", "displayFormat")})
    return Table(df, meta["name"], meta["label"], {"records": meta["rows"], **encoding_meta(code, "DECLARED" if meta["encoding"] else "CONFIGURED" if encoding else "DEFAULT")})
