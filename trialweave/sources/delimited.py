"""Delimited text whose quotes carry meaning: quoted cells are text, unquoted dots are missing markers.

Cells come as Arrow batches of text with a quote flag each; typing and missing rules are Spark expressions.  One pass
counts the lines of every split, to number records over splits and files, and looks for lines of an odd number of
quotes.  Without such lines every line is a record.  Otherwise a record may hold line breaks: a pass over each split
tells how many records begin in it and whether it ends within quotes, for either way to begin; from that each split's
beginning is known, splits are parsed apart, and the records that run over their bounds are put together.  Only with
other encodings than UTF-8 and delimiters of several characters files with such records are read whole, one task a file.
Types come from the first ``guess`` records.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import is_sentinel, sentinel_code, strip
from ..model.table import ROW, Table, encoding_meta, mis
from ..shared import shared_dir
from .lines import numbered, split_lines
from .normalise import RULES, text_cell, text_number_cells

GUESS, CANDIDATES = 10_240, ",\t;"


def records(text: str, delimiter: str, quote: str = '"', escape: str = '"'):
    """Records of a delimited text: lists of (cell, was quoted)."""
    row, cell, was, i, n = [], [], False, 0, len(text)
    run = re.compile(f"[^{re.escape(delimiter)}\r\n]+" if len(delimiter) == 1 else "(?s:.)")
    while i < n:
        ch = text[i]
        if ch == quote and not cell and not was:
            was, i = True, i + 1
            while i < n:
                if text[i] == escape and i + 1 < n and text[i + 1] == quote:
                    cell.append(quote)
                    i += 2
                elif text[i] == quote:
                    i += 1
                    break
                else:
                    j = min((k for k in (text.find(quote, i), text.find(escape, i)) if k >= 0), default=n)
                    cell.append(text[i : max(j, i + 1)])
                    i = max(j, i + 1)
        elif ch == delimiter:
            row.append(("".join(cell), was))
            cell, was, i = [], False, i + 1
        elif ch in "\r\n":
            i += 2 if text[i : i + 2] == "\r\n" else 1
            row.append(("".join(cell), was))
            yield row
            row, cell, was = [], [], False
        else:
            cell.append(found := run.match(text, i).group())
            i += len(found)
    if row or cell or was:
        row.append(("".join(cell), was))
        yield row


def detect(line: str, quote: str = '"') -> str:
    """The delimiter that is most frequent outside quotes of the first line; ties: comma, tab, semicolon."""
    outside = "".join(line.split(quote)[::2])
    return max(CANDIDATES, key=lambda d: (outside.count(d), -CANDIDATES.index(d)))


def header(cells: list[str]) -> list[str]:
    """Column names: blank ones V<n>, repeated ones _2, _3 (whatever their case)."""
    out, seen = [], set()
    for i, c in enumerate(cells, 1):
        base = c.strip() or f"V{i}"
        name, k = base, 1
        while name.lower() in seen:
            k += 1
            name = f"{base}_{k}"
        seen.add(name.lower())
        out.append(name)
    return out


_CELLS = pa.list_(pa.struct([("v", pa.string()), ("q", pa.bool_())]))


def _by_line(delimiter: str, quote: str, escape: str):
    def of(batches):
        for b in batches:
            rows = []
            for line in b["line"].to_pylist():
                cells = [(v, False) for v in line.split(delimiter)] if quote not in line else next(records(line, delimiter, quote, escape), [("", False)])
                rows.append([{"v": v, "q": q} for v, q in cells])
            yield pa.record_batch({ROW: b[ROW], "c": pa.array(rows, _CELLS)})

    return of


class _Quotes:
    """Follows the quotes of ``records`` from line to line (parted by line feeds) without making cells."""

    def __init__(self, delimiter: str, quote: str, escape: str):
        q, e = re.escape(quote), re.escape(escape)
        self.quote, self.body = quote, re.compile(f"(?:{e}{q}|[^{q}])*+")
        self.rest = re.compile(f"[^{re.escape(delimiter)}\r]*+")

    def step(self, line: str, inside: bool) -> tuple[bool, int]:
        """(whether the line's end is within quotes, records that begin within the line)."""
        if self.quote not in line and (inside or "\r" not in line):
            return inside, 0
        n, at, more = len(line), 0, 0
        opened = inside
        while True:
            if opened or line.startswith(self.quote, at):
                at = self.body.match(line, at if opened else at + 1).end()
                if at == n:
                    return True, more
                at, opened = at + 1, False
            at = self.rest.match(line, at).end()
            if at == n:
                return False, more
            more += line[at] == "\r" and at < n - 1
            at += 1


_SPLIT = "file string, block bigint, ends_out boolean, ends_in boolean, n_out bigint, n_in bigint, bytes bigint, size bigint"


def _survey(quotes: _Quotes):
    """A row a split: its end (within quotes or not) and the records that begin in it, by how it begins; its bytes."""

    def of(batches):
        key, held = None, None
        for b in batches:
            for file, block, line, long, size in zip(*(b[c].to_pylist() for c in ("file", "block", "line", "long", "size")), strict=True):
                if (file, block) != key:
                    if key:
                        yield _surveyed(key, held)
                    key, held = (file, block), [False, True, 0, 0, 0, size]
                out, within = held[:2]
                held[0], more = quotes.step(line, out)
                held[2] += (not out) + more
                held[1], more = (held[0], more) if out == within else quotes.step(line, within)
                held[3] += (not within) + more
                held[4] += long + 1
        if key:
            yield _surveyed(key, held)

    return of


def _surveyed(key, held) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in _SPLIT.split(", ")], (*key, *held), strict=True))])


_PARTS = pa.schema([("file", pa.string()), ("block", pa.int64()), (ROW, pa.int64()), ("head", pa.bool_()), ("bare", pa.bool_()), ("c", _CELLS), ("text", pa.string())])


def _parts(delimiter: str, quote: str, escape: str, what: str, size: int = 5000):
    """Of splits whose beginning is known: their whole records, their heads only, or the pieces of records that others share.

    A piece has the record's ``__row`` where the record begins in the split, else none.
    """
    quotes = _Quotes(delimiter, quote, escape)

    def of(batches):
        key, out = None, []
        piece = lambda: {"file": key[0], "block": key[1], ROW: None if lead else at, "head": begun == 0 and key[1] == 0 and not lead, "bare": bare, "c": None, "text": "\n".join([*held, ""])}
        for b in batches:
            for file, block, inside_first, offset, ends_bare, line in zip(*(b[c].to_pylist() for c in ("file", "block", "inside", "offset", "bare", "line")), strict=True):
                if (file, block) != key:
                    if key and held and what == "pieces":
                        out.append(piece())
                    key, held, more, begun = (file, block), [], 0, 0
                    inside = lead = inside_first
                    at, bare = offset, ends_bare
                if what == "heads" and (begun or block):
                    continue
                held.append(line)
                inside, found = quotes.step(line, inside)
                more += found
                if inside:
                    continue
                if lead:
                    if what == "pieces":
                        out.append(piece())
                    at += more
                else:
                    if what != "pieces":
                        rows = records("\n".join([*held, ""]), delimiter, quote, escape)
                        out += [{"file": file, "block": block, ROW: at + i, "head": begun + i == 0 and block == 0, "bare": bare, "c": [{"v": v, "q": q} for v, q in r], "text": None} for i, r in enumerate(rows)]
                    at, begun = at + 1 + more, begun + 1 + more
                held, more, lead = [], 0, False
                if len(out) >= size:
                    yield pa.RecordBatch.from_pylist(out, schema=_PARTS)
                    out = []
        if key and held and what == "pieces":
            out.append(piece())
        yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    return of


def _joined(delimiter: str, quote: str, escape: str):
    """Records of texts that were put together; only a text's first record is a header."""

    def of(batches):
        for b in batches:
            for r in b.to_pylist():
                text = r["text"][:-1] if r["bare"] else r["text"]
                yield pa.RecordBatch.from_pylist([{**r, ROW: r[ROW] + i, "head": r["head"] and i == 0, "c": [{"v": v, "q": q} for v, q in x], "text": None} for i, x in enumerate(records(text, delimiter, quote, escape))], schema=_PARTS)

    return of


def _over_lines(spark: SparkSession, path: str, delimiter: str, quote: str, escape: str, guess: int) -> tuple[list[str], DataFrame, DataFrame]:
    """(names, records, at least the first ``guess`` of them) of files whose records may hold line breaks."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*meta, F.col("value").alias("line"))
    splits = lines.withColumn("long", F.octet_length("line")).mapInArrow(_survey(_Quotes(delimiter, quote, escape)), _SPLIT)
    where = f"{shared_dir(spark)}/delimited/{uuid.uuid4().hex}"
    splits.write.parquet(f"{where}/splits")  # one short row a split: one task adds them up
    of_file = Window.partitionBy("file").orderBy("block")
    until = of_file.rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum(F.when(F.col("ends_out") & ~F.col("ends_in"), 1).otherwise(0)).over(until)
    fixed = F.last(F.when(F.col("ends_out") == F.col("ends_in"), F.struct("ends_out", "turns")), ignorenulls=True).over(until)
    after = F.coalesce(F.col("fixed.ends_out"), F.lit(False)) != ((F.col("turns") - F.coalesce(F.col("fixed.turns"), F.lit(0))) % 2 == 1)
    known = spark.read.schema(_SPLIT).parquet(f"{where}/splits").withColumn("turns", turned).withColumn("fixed", fixed).withColumn("after", after)
    known = known.withColumn("inside", F.coalesce(F.lag("after").over(of_file), F.lit(False)))
    counted = F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")) - F.when(F.col("block") == 0, 1).otherwise(0)
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(counted).over(before), F.lit(0)) - F.when(F.col("block") == 0, 1).otherwise(0)
    bare = F.sum("bytes").over(Window.partitionBy("file")) > F.col("size")  # no line feed at the end
    known = known.select(F.xxhash64("file").alias("f"), F.col("block").alias("b"), "inside", offset.alias("offset"), bare.alias("bare"))
    # broadcast, so that lines stay in their order
    begun = lines.join(F.broadcast(known), (F.xxhash64("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", "block", "inside", "offset", "bare", "line")
    kinds = f"file string, block bigint, {ROW} bigint, head boolean, bare boolean, c array<struct<v:string,q:boolean>>, text string"
    parts = lambda rows, what: rows.mapInArrow(_parts(delimiter, quote, escape, what), kinds)
    begins = F.last(ROW, ignorenulls=True).over(Window.partitionBy("file").orderBy("block", F.col(ROW).asc_nulls_first()))
    pieces = parts(begun, "pieces").withColumn("begins", begins).groupBy("file", "begins").agg(F.min("block").alias("block"), F.bool_or("head").alias("head"), F.bool_or("bare").alias("bare"), F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "text"))).alias("all"))
    pieces = pieces.select("file", "block", F.col("begins").alias(ROW), "head", "bare", F.lit(None).cast("array<struct<v:string,q:boolean>>").alias("c"), F.array_join("all.text", "").alias("text"))
    pieces.mapInArrow(_joined(delimiter, quote, escape), kinds).write.parquet(f"{where}/joined")
    joined = spark.read.schema(kinds).parquet(f"{where}/joined")
    head = parts(begun.where("block = 0"), "heads").unionByName(joined).where("head").orderBy("file").select("c").first()
    rows = lambda of: parts(of, "records").unionByName(joined).where("NOT head").select(ROW, "c")
    return header([x["v"] for x in head["c"]] if head else []), rows(begun), rows(begun.where(F.col("offset") < guess))


def _whole(delimiter: str, quote: str, escape: str, encoding: str, size: int = 5000):
    """(file, block 0, place, cells) of the records of whole files; place 0 is the header."""

    def of(batches):
        for b in batches:
            for path, raw in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                part, start = [], 0
                for r in records(raw.decode(encoding), delimiter, quote, escape):
                    part.append([{"v": v, "q": q} for v, q in r])
                    if len(part) == size:
                        yield _placed(path, start, part)
                        start, part = start + size, []
                yield _placed(path, start, part)

    return of


def _placed(path: str, start: int, part: list) -> pa.RecordBatch:
    return pa.record_batch({"file": pa.array([path] * len(part), pa.string()), "block": pa.array([0] * len(part), pa.int64()), "place": pa.array(range(start, start + len(part)), pa.int64()), "c": pa.array(part, _CELLS)})


def read(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"', escape: str = '"', encoding: str = "UTF-8", guess: int = GUESS, name: str = "") -> Table:
    """A delimited file, or a folder of files that each have the header, as a table; row identity is the record's place."""
    first = spark.read.text(path).first()
    delimiter = delimiter or detect(first[0] if first else "", quote)
    cells = "array<struct<v:string,q:boolean>>"
    plain = encoding.upper().replace("-", "") == "UTF8" and len(quote) == 1
    lines, odd = split_lines(spark, path, quote) if plain else (None, True)
    first_rows = None
    if not odd:
        names = header([c for c, _ in next(records(first[0] if first else "", delimiter, quote, escape), [])])
        by_line = lambda of: of.where("NOT head").select(ROW, "line").mapInArrow(_by_line(delimiter, quote, escape), f"{ROW} bigint, c {cells}")
        rows, first_rows = by_line(lines), by_line(lines.where(F.col(ROW) < guess))
    elif plain and len(delimiter) == len(escape) == 1:
        names, rows, first_rows = _over_lines(spark, path, delimiter, quote, escape, guess)
    else:
        whole = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_whole(delimiter, quote, escape, encoding), f"file string, block bigint, place bigint, c {cells}")
        head = whole.where("place = 0").orderBy("file").select("c").first()
        names = header([x["v"] for x in head["c"]] if head else [])
        rows = numbered(whole).where("NOT head").select(ROW, "c")
    return Table(typed(rows, names, guess, first_rows), name, meta=encoding_meta(encoding.upper(), "DEFAULT" if plain else "CONFIGURED"))


def typed(rows: DataFrame, names: list[str], guess: int, first: DataFrame | None = None) -> DataFrame:
    """Typed columns of records; ``first``: a table that holds the first ``guess`` of them, if there is a cheaper one."""
    rules = RULES["csv"]
    cell = lambda i, f: F.get(F.col("c"), F.lit(i))[f]
    tests = []
    for i in range(len(names)):
        v, q = strip(cell(i, "v")), F.coalesce(cell(i, "q"), F.lit(False))
        number = v.try_cast("double").isNotNull()
        fits = v.isNull() | (~q & ((v == "") | number | is_sentinel(v)))
        tests += [F.coalesce(F.bool_and(fits), F.lit(False)).alias(f"f{i}"), F.coalesce(F.bool_or(number & ~q), F.lit(False)).alias(f"n{i}")]
    seen = (rows if first is None else first).where(F.col(ROW) < guess).agg(*tests).first() if names else None
    out = [F.col(ROW)]
    for i, n in enumerate(names):
        v, q = cell(i, "v"), cell(i, "q")
        if seen[f"f{i}"] and seen[f"n{i}"]:
            value, code = text_number_cells(v, rules, q)
            out += [value.alias(n), code.alias(mis(n))]
        else:
            marker = ~F.coalesce(q, F.lit(False)) & is_sentinel(v)
            out += [F.when(~marker, text_cell(v, rules)).alias(n), F.when(marker, sentinel_code(v)).cast("tinyint").alias(mis(n))]
    return rows.select(*out)
