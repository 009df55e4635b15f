"""Exact removal of repeated long substrings with a logarithmic family of sparse suffix indexes.

Every 400-byte string that starts in two places is found, and the bytes that such strings cover are removed.  Passages
of over 50 words that another document holds too may be shorter than that: ``passages`` counts them, they stay.

Sparse suffixes.  Of the 337 64-byte strings inside a 400-byte window the one of least hash (leftmost of equals) is
the window's anchor; equal windows have equal anchors at equal offsets.  The windows of one anchor are neighbours, so
about one suffix in 170 bytes is indexed: its ``core`` (hash of the 64 bytes at the anchor) and its ``content`` (hash
of all bytes of the anchor's windows).  A suffix array here is the table of those suffixes in order of (core, content),
one row a content, with how often it occurs.

Logarithmic index.  Documents come in batches.  A batch is sorted into a suffix array, a level of rank 0; while there
are two levels of one rank they are merge-scanned into one of the next, and against the other levels the batch is
scanned for equal cores and contents.  Every suffix is rewritten log2(batches) times.

Refinement.  Equal contents: all their windows are repeated.  Equal cores with different contents agree in part: their
windows are regrouped by 43 offsets to a finer core of 358 bytes and a finer content, and what still differs is
regrouped by single windows, whose core is the whole 400 bytes.  Only one representative of each content takes part.
So the work follows the number of places where repeats begin or end, however often a passage is repeated, no pairs
are made, and every step is a grouping with partial aggregation or a join that adaptive execution may split.

Hashes: contents are compared under (core, content), 128 bits together.

Defined results: null and empty texts have 0 bytes and the hash of nothing.  Repeated rows repeat each other's strings,
and each is another document.  Null doc_id is a value like any other.  Equal texts lose equal bytes.  Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_stage, small, stage, table, text_key
from .textkit import batch_bytes, mix, prefix_hash, row_of, slices, span_hash

LENGTH, GRAM, GROUP = 400, 64, 43
BATCHES = 4
#: Rows up to which a table of one row per text, or of cores and contents, is broadcast.
MAX_BROADCAST_ROWS = 300_000

_SPAN = "tk bigint, core bigint, content bigint, s int, e int, p int"
_U = np.uint64
_PLACE = ("tk", "s", "e", "p")


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` keys, by block prefix and suffix minima."""
    n = len(key)
    pad = -n % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(key.dtype).max, key.dtype)]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchors(prefix: np.ndarray, offsets: np.ndarray, length: int = LENGTH, size: int = GRAM):
    """(row, core, content, s, e, p) of every anchor; windows s..e and the anchor p, counted from the row's start."""
    n = len(prefix) - 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    at = np.arange(n - size + 1)
    gram = span_hash(prefix, at, at + size)
    key = (gram & ~_U(0xFFFFFFFF)) | at.astype(_U)
    least = window_minima(key, length - size + 1) & _U(0xFFFFFFFF)
    anchor = least.astype(np.int64)
    row = row_of(offsets, n)
    start = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])  # windows inside one row
    if not len(start):
        return none, none, none, none, none, none
    a, r = anchor[start], row[start]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    s, e, p, r = start[first], start[last], a[first], r[first]
    content = mix(span_hash(prefix, s, e + length) ^ mix((p - s).astype(_U)))
    base = offsets[r]
    return r, gram[p].view(np.int64), content.view(np.int64), s - base, e - base, p - base


def _spans(part, r, core, content, s, e, p):
    return pa.record_batch({"tk": part["tk"].take(pa.array(r)), "core": pa.array(core), "content": pa.array(content), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32)), "p": pa.array(p.astype(np.int32))})


def suffixes(rows: DataFrame) -> DataFrame:
    """The sparse suffixes of all documents (tk, text), with their batch."""

    def of(batches):
        for b in batches:
            for part in slices(b):
                data, offsets = batch_bytes(part["text"])
                yield _spans(part, *anchors(prefix_hash(data), offsets))

    return rows.select("tk", "text").mapInArrow(of, _SPAN).withColumn("batch", F.pmod(F.xxhash64("tk"), F.lit(BATCHES)).cast("int"))


class SuffixIndex:
    """Levels of sorted sparse suffixes: (core, content, n), one row per content."""

    def __init__(self, levels: dict[int, DataFrame] | None = None):
        """``levels`` by rank, as an earlier index has left them: later batches meet them."""
        self.levels: dict[int, DataFrame] = dict(levels or {})
        self.repeated: list[DataFrame] = []  # (core, content) that a scan found twice
        self.mixed: list[DataFrame] = []  # cores of which a scan found different contents

    def add(self, batch: DataFrame) -> None:
        """Suffixes (core, content): a suffix array, scanned against the levels and merged with equal ones."""
        run = batch.groupBy("core", "content").agg(F.count(F.lit(1)).alias("n"))
        run = stage(run.sortWithinPartitions("core", "content"), "suffix-array")
        rank = 0
        while rank in self.levels:
            rank += 1
        for r, level in self.levels.items():
            if r > rank:  # those below are merged, which compares them
                self._scan(run, level)
        for r in range(rank):
            run = self._merge(run, self.levels.pop(r))
        self.levels[rank] = run

    @staticmethod
    def _ends(run: DataFrame) -> DataFrame:
        return run.groupBy("core").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))

    def _scan(self, run: DataFrame, level: DataFrame) -> None:
        """Merge-scan in core order; what is found is kept, for the level itself may be merged away."""
        both = run.select("core", "content").join(level.select("core", "content"), ["core", "content"])
        self.repeated.append(stage(both, "repeated"))
        a, b = self._ends(run), self._ends(level).select("core", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        differ = (F.col("lo") != F.col("hi2")) | (F.col("hi") != F.col("lo2"))
        self.mixed.append(stage(a.join(b, "core").where(differ).select("core"), "mixed"))

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        merged = a.unionByName(b).groupBy("core", "content").agg(F.sum("n").alias("n"))
        merged = stage(merged.sortWithinPartitions("core", "content"), "level")
        drop_stage(a)
        drop_stage(b)
        return merged

    def found(self) -> tuple[DataFrame, DataFrame]:
        """(repeated contents, mixed cores) of everything added so far."""
        levels = list(self.levels.values())
        again = [x.where("n > 1").select("core", "content") for x in levels] + self.repeated
        mixed = [self._ends(x).where("lo <> hi").select("core") for x in levels] + self.mixed
        return reduce(DataFrame.unionByName, again).distinct(), reduce(DataFrame.unionByName, mixed).distinct()


def _refine(rows: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """Units of ``width`` neighbouring windows of the representatives, with finer cores and contents."""
    # a place in one number: s, and how far e and p lie behind it (less than LENGTH each)
    place = F.shiftleft(F.col("s").cast("bigint"), 22) + F.shiftleft((F.col("e") - F.col("s")).cast("bigint"), 11) + (F.col("p") - F.col("s"))
    per_text = reps.groupBy("tk").agg(F.collect_list(F.struct("core", place.alias("place"))).alias("u"))
    per_text = small(stage(per_text, f"refine-{width}"), MAX_BROADCAST_ROWS, F.size("u"))
    met = rows.join(per_text, "tk").select("tk", "text", "u")

    def of(batches):
        for b in batches:
            for part in slices(b):
                data, offsets = batch_bytes(part["text"])
                prefix = prefix_hash(data)
                lists = part["u"]
                count = np.asarray(pa.compute.list_value_length(lists), np.int64)
                flat = lists.flatten()
                core, place = np.asarray(flat.field("core")), np.asarray(flat.field("place"))
                s = place >> 22
                e, p = s + ((place >> 11) & 2047), s + (place & 2047)
                r = np.repeat(np.arange(len(part)), count)
                lo, hi = (p - e) // width, (p - s) // width  # groups of offsets p - window
                reps_of = hi - lo + 1
                unit = np.repeat(np.arange(len(p)), reps_of)
                j = np.arange(len(unit)) - np.repeat(np.cumsum(reps_of) - reps_of, reps_of) + lo[unit]
                base = offsets[r[unit]]
                us = np.maximum(s[unit], p[unit] - (j + 1) * width + 1)
                ue = np.minimum(e[unit], p[unit] - j * width)
                a = base + p[unit] - j * width  # the last window's start: all windows of the group hold [a, z)
                z = a - width + 1 + LENGTH
                fine = mix(span_hash(prefix, a, z) ^ mix(core[unit].view(_U) + j.astype(_U)))
                content = mix(span_hash(prefix, base + us, base + ue + LENGTH) ^ mix((p[unit] - us).astype(_U)))
                yield _spans(part, r[unit], fine.view(np.int64), content.view(np.int64), us, ue, p[unit])

    return met.mapInArrow(of, _SPAN)


def _representatives(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """One place of every different content of the mixed cores."""
    hit = rows.join(mixed, "core", "left_semi").groupBy("core", "content").agg(F.min(F.struct(*_PLACE)).alias("place"))
    return hit.select("core", "place.*")


def repeated_windows(rows: DataFrame, sparse: DataFrame) -> DataFrame:
    """(tk, s, e): ranges of window starts whose 400 bytes occur elsewhere too."""
    index = SuffixIndex()
    for i in range(BATCHES):
        index.add(sparse.where(F.col("batch") == i).select("core", "content"))
    again, mixed = (small(stage(x, "found"), MAX_BROADCAST_ROWS) for x in index.found())
    for level in index.levels.values():
        drop_stage(level)
    out = [sparse.join(again, ["core", "content"], "left_semi").select("tk", "s", "e")]
    reps = _representatives(sparse, mixed)
    for width in (GROUP, 1):
        units = stage(_refine(rows, reps, width), f"units-{width}")
        # two places make a repeat; copies of a text have one place here, and are known to be repeated
        at = F.struct("tk", "s")
        by = stage(units.groupBy("core", "content").agg((F.min(at) != F.max(at)).alias("twice")), f"contents-{width}")
        again = small(stage(by.where("twice").select("core", "content"), "found"), MAX_BROADCAST_ROWS)
        out.append(units.join(again, ["core", "content"], "left_semi").select("tk", "s", "e"))
        if width > 1:
            reps = _representatives(units, small(stage(SuffixIndex._ends(by).where("lo <> hi").select("core"), "mixed"), MAX_BROADCAST_ROWS))
    return reduce(DataFrame.unionByName, out)


def _keyed(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tk", text_key())


def _cover(batches):
    """From the packed window ranges of each text to its maximal runs of covered bytes, packed alike."""
    for b in batches:
        runs = []
        for u in b["u"].to_pylist():
            out: list[list[int]] = []
            for x in sorted(u):
                s, e = x >> 32, (x & 0xFFFFFFFF) + LENGTH
                if out and s <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            runs.append([s << 32 | e for s, e in out])
        yield pa.record_batch({"tk": b["tk"], "u": pa.array(runs, pa.list_(pa.int64()))})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, kept (the remaining bytes).

    ``n_passages``: different windows of 51 words that another document holds too; 0 if no passage of over 50 words is shared.
    """
    from .passages import n_windows, shared_windows

    rows = _keyed(docs)
    sparse = stage(suffixes(rows), "suffixes", by="batch")
    packed = F.shiftleft(F.col("s").cast("bigint"), 32) + F.col("e")
    ranges = repeated_windows(rows, sparse).groupBy("tk").agg(F.collect_set(packed).alias("u"))
    ranges = stage(ranges.mapInArrow(_cover, "tk bigint, u array<bigint>"), "ranges")
    copies = rows.groupBy("tk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tk", F.lit(True).alias("copied"))
    passages = shared_windows(rows, sparse.count())
    found = ranges.join(passages, "tk", "full_outer").join(copies, "tk", "full_outer")
    found = small(stage(found, "found"), MAX_BROADCAST_ROWS, F.greatest(F.size("u"), F.lit(1)))
    met = rows.join(found, "tk", "left").select("doc_id", "text", "u", F.coalesce("n_windows", F.lit(0).cast("bigint")).alias("n_windows"), F.coalesce("copied", F.lit(False)).alias("copied"))

    def of(batches):
        for b in batches:
            for part in slices(b):
                copied, n = np.asarray(part["copied"].to_numpy(zero_copy_only=False), bool), np.asarray(part["n_windows"])
                if copied.any():  # every window of a copied text stands in its copy
                    n = np.where(copied, n_windows(part["text"]), n)
                out = {"doc_id": part["doc_id"].to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "n_passages": n.tolist(), "kept": []}
                for raw, u in zip(part["text"].cast(pa.binary()).to_pylist(), part["u"].to_pylist(), strict=True):
                    spans = [(x >> 32, x & 0xFFFFFFFF) for x in u or ()]
                    at, kept = 0, []
                    for s, e in spans:
                        kept.append(raw[at:s])
                        at = e
                    kept = b"".join([*kept, raw[at:]])
                    out["n_bytes"].append(len(raw))
                    out["n_removed"].append(len(raw) - len(kept))
                    out["n_spans"].append(len(spans))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(kept)
                kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
                yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return met.mapInArrow(of, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, kept binary")


def op1_substrings(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op1_substrings": op1_substrings}
SQL: dict = {}
