"""SAS7BDAT: small files made here, read back, and compared with pandas' own reader."""

import struct

import numpy as np
import pytest

from trialweave.model.table import ROW
from trialweave.sources import catalog, sas7bdat

W, PAGE, HEADER = 4, 4096, 1024


def subheader(sign, length):
    return bytearray(struct.pack("<I", sign).ljust(length, b"\0"))


def make(columns, rows, compression="", deleted=()):
    """A little-endian file of 32-bit words.  columns: (name, label, length, number); rows of values."""
    at, attributes = 0, []
    for _, _, length, number in columns:
        attributes.append((at, length, 1 if number else 2))
        at += length
    width = at

    def cell(v, length, number):
        if not number:
            return v.encode().ljust(length)
        raw = struct.pack("<d", v) if isinstance(v, float) else struct.pack("<Q", v)
        return raw[8 - length :]

    body = [b"".join(cell(v, c[2], c[3]) for v, c in zip(r, columns, strict=True)) for r in rows]
    text, where = bytearray(b"\0\0\0\0" + b"\0" * 12 + compression.encode().ljust(8)), []
    for name, label, _, _ in columns:
        where.append(((len(text), len(name)), (len(text) + len(name), len(label))))
        text += name.encode() + label.encode()
    struct.pack_into("<H", text, 0, len(text))
    size = subheader(sas7bdat.ROW_SIZE, 480)
    for i, v in ((5, width), (6, len(rows)), (9, len(columns)), (15, len(rows))):
        struct.pack_into("<i", size, i * W, v)
    count = subheader(sas7bdat.COLUMN_SIZE, 12)
    struct.pack_into("<i", count, W, len(columns))
    subs = [size, count, subheader(sas7bdat.COLUMN_TEXT, W) + text]
    names = subheader(sas7bdat.COLUMN_NAME, W + 8 + 8 * len(columns) + W + 4)
    attrs = subheader(sas7bdat.COLUMN_ATTRIBUTES, W + 8 + (W + 8) * len(columns) + W + 4)
    for i, ((n, _), (a, length, kind)) in enumerate(zip(where, attributes, strict=True)):
        struct.pack_into("<HHH", names, W + 8 + 8 * i, 0, *n)
        struct.pack_into("<iiHB", attrs, W + 8 + (W + 8) * i, a, length, 0, kind)
    subs += [names, attrs]
    for _, label in where:
        f = subheader(sas7bdat.FORMAT_LABEL, 3 * W + 22 + 18)
        struct.pack_into("<HHH", f, 3 * W + 28, 0, *label)
        subs.append(f)
    header = bytearray(HEADER)
    header[:32] = sas7bdat.MAGIC
    header[32], header[35], header[37], header[39], header[70] = 0x22, 0x32, 1, ord("1"), 20
    header[84:92] = b"SAS FILE"
    header[92:156], header[156:164] = b"DM".ljust(64), b"DATA    "

    def page(subheaders, rest, kind, blocks):
        out = bytearray(PAGE)
        end = PAGE
        for i, (raw, pointer) in enumerate(subheaders):
            end -= len(raw)
            out[end : end + len(raw)] = raw
            struct.pack_into("<iiBB", out, 16 + 8 + 12 * i, end, len(raw), *pointer)
        struct.pack_into("<HHH", out, 16, kind, blocks, len(subheaders))
        struct.pack_into("<i", out, 12, 8)
        at = 16 + 8 + 12 * len(subheaders)
        at += at % 8
        assert at + len(rest) <= end
        out[at : at + len(rest)] = rest
        return bytes(out)

    meta = [(s, (0, 0)) for s in subs]
    if compression:
        packed = [(bytes([0x80 + len(b) - 1]) + b if len(b) <= 16 else b, (4 if len(b) <= 16 else 0, 1)) for b in body]
        pages = [page(meta, b"", 0, len(meta)), page(packed, b"", 0, len(packed))]
    else:
        first = 3  # rows beside the metadata, the others on a page of data
        struct.pack_into("<i", size, 15 * W, first)
        bits = np.packbits([i in deleted for i in range(first)]).tobytes()
        pages = [page([(size, (0, 0)), *meta[1:]], b"".join(body[:first]) + bits, 0x200 | (0x80 if deleted else 0), first + len(meta)), page([], b"".join(body[first:]), 0x100, len(body) - first)]
    struct.pack_into("<ii", header, 196, HEADER, PAGE)
    struct.pack_into("<i", header, 204, len(pages))
    return bytes(header) + b"".join(pages)


COLUMNS = [("USUBJID", "Subject", 6, False), ("AGE", "Years", 8, True), ("SHORT", "Three bytes", 3, True)]
ROWS = [("s1é", 34.5, 2.0), ("s2", 0xFFFFFE0000000000, -1.5), ("", 0xFFFFFD0000000000, 0.0), ("s4", 0xFFFFFF0000000000, 8.0), ("s5", float("inf"), 1.0), ("s6", -1e300, 4096.0), ("s7", 0x7FF8000000000000, 3.0)]
WANT = [("s1é", 34.5, None, 2.0), ("s2", None, 64, -1.5), ("", None, 65, 0.0), ("s4", None, 60, 8.0), ("s5", None, 102, 1.0), ("s6", -1e300, None, 4096.0), ("s7", None, 64, 3.0)]


def got(t):
    return [(r["USUBJID"], r["AGE"], r["AGE__mis"], r["SHORT"]) for r in t.df.orderBy(ROW).collect()]


def test_values_and_markers(spark, tmp_path):
    import pandas

    path = tmp_path / "dm.sas7bdat"
    path.write_bytes(make(COLUMNS, ROWS))
    t = catalog.read(spark, str(path))
    assert got(t) == WANT and t.name == "DM" and t.labels()["AGE"] == "Years"
    assert [r[ROW] for r in t.df.orderBy(ROW).collect()] == list(range(7)) and t.meta["Encoding"] == "utf-8"
    other = pandas.read_sas(path, encoding="utf-8")
    assert list(other.columns) == [c[0] for c in COLUMNS] and other["AGE"].dropna().tolist()[0] == 34.5 and other["SHORT"].tolist() == [r[2] for r in ROWS]


def test_deleted_rows_are_left_out(spark, tmp_path):
    path = tmp_path / "dm.sas7bdat"
    path.write_bytes(make(COLUMNS, ROWS, deleted=(1,)))
    assert got(catalog.read(spark, str(path))) == WANT[:1] + WANT[2:]


@pytest.mark.parametrize("compression", ["SASYZCRL", "SASYZCR2"])
def test_rows_in_subheaders(spark, tmp_path, compression):
    columns = COLUMNS if compression == "SASYZCRL" else [("USUBJID", "Subject", 12, False), *COLUMNS[1:]]
    path = tmp_path / "dm.sas7bdat"
    path.write_bytes(make(columns, ROWS, compression) if compression == "SASYZCR2" else make([("USUBJID", "Subject", 5, False), *COLUMNS[1:]], ROWS, compression))
    assert got(catalog.read(spark, str(path))) == WANT


def test_runs():
    row = b"abc" + b"\0" * 40 + b" " * 30 + b"z" * 25 + b"end"
    raw = b"\x82abc" + bytes([0x70, 23]) + bytes([0x60, 13]) + bytes([0x40, 7]) + b"z" + b"\x82end"
    assert sas7bdat.unpack_rle(raw, len(row)) == row
    raw = bytes([0b00011100, 0]) + b"abc" + bytes([0x05, ord("x")]) + bytes([0x33, 0]) + bytes([0x10, 1]) + b"y" + b"q"
    assert sas7bdat.unpack_rdc(raw, 3 + 8 + 3 + 35 + 1) == b"abc" + b"x" * 8 + b"xxx" + b"y" * 35 + b"q"


def test_not_a_file(spark):
    with pytest.raises(sas7bdat.Sas7bdatError):
        sas7bdat.describe(b"nothing of the kind" * 20)
