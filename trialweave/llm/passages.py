"""Passages of over 50 words that another text holds too: which texts have them, and in how many windows of 51 words.

Windows are sampled as in ``substrings``: of the strings of 8 words inside a window of 51 the one of least hash is its
anchor, so that equal windows have equal anchors.

1. Anchors' strings are packed, in buckets of their hashes, with the key of their text; a bucket tells which of its
   strings several texts hold.
2. Texts that have such strings pack all windows of those anchors alike; a bucket tells which windows several texts
   hold, and counts them for each.

Only hashes move, 12 bytes an anchor and 16 a window.  What several texts of one flush of a task hold is known at once:
their entries are shipped as they are, spread over all tasks, and the bucket gets one mark.  So of a string that a
third of all texts hold a bucket gets one entry a flush, not one a text.  Windows are compared by 64 bits, words
without regard to A-Z's case.  A text that stands in several rows is left to the caller: all its windows are shared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage
from .substrings import anchors
from .textkit import SPACE_WORDS, batch_bytes, mix, prefix_hash, slices, span_hash, word_hashes, words

#: Words of a window, and of the strings that sample it.
LENGTH, GRAM = 51, 8
#: Entries gathered in a task before they are shipped; entries of a bucket, about.
FLUSH, BUCKET = 250_000, 200_000
#: Sure entries that are shipped together.
PIECE = 20_000
#: Rows up to which the texts' lists are broadcast.
MAX_BROADCAST_ROWS = 300_000
_U = np.uint64
_PACKED = "bucket int, packed binary, sure binary"


def sequence(text) -> tuple[np.ndarray, np.ndarray]:
    """(prefix hash over the words, n+1 offsets of the rows)."""
    data, offsets = batch_bytes(text)
    low, starts, ends, at = words(data, offsets, SPACE_WORDS)
    return prefix_hash(word_hashes(low, starts, ends)), at


def n_windows(text) -> np.ndarray:
    """Different windows of each row."""
    prefix, offsets = sequence(text)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= LENGTH:
            start = np.arange(a, b - LENGTH + 1)
            out[i] = len(np.unique(span_hash(prefix, start, start + LENGTH)))
    return out


class _Packer:
    """(token, key) pairs of a task, packed by bucket whenever there are many; key 0 marks a token of several keys."""

    def __init__(self, buckets: int, kind: str):
        self.buckets, self.kind, self.held, self.n = buckets, kind, [], 0

    def add(self, token: np.ndarray, key: np.ndarray):
        self.held.append((token, np.where(key == 0, 1, key)))
        self.n += len(token)
        if self.n >= FLUSH:
            yield from self.flush()

    def named(self, token: np.ndarray) -> np.ndarray:
        """What is left of a token in a bucket."""
        return (token & ~_U(0xFFFFFFFF)) | ((token & _U(0xFFFFFFFF)) % _U(self.buckets)) if self.kind == "u4" else token

    def flush(self):
        if not self.n:
            return
        t, k = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        once = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        t, k = t[once], k[once]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.concatenate([first, [len(t)]]))
        sure = np.repeat(size > 1, size)
        for i in range(0, int(sure.sum()), PIECE):
            st, sk = t[sure][i : i + PIECE], k[sure][i : i + PIECE]
            spread = int(mix(st[:1] ^ sk[:1].view(_U))[0] % _U(self.buckets))
            yield pa.record_batch({"bucket": pa.array([spread], pa.int32()), "packed": pa.nulls(1, pa.binary()), "sure": pa.array([self.named(st).tobytes() + sk.tobytes()], pa.binary())})
        k = np.where(size > 1, 0, k[first])
        t = t[first]
        bucket = (t & _U(0xFFFFFFFF)) % _U(self.buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, t, k = bucket[order], (t[order] >> _U(32)).astype(np.uint32) if self.kind == "u4" else t[order], k[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.concatenate([cut[1:], [len(bucket)]])
        raw = [t[i:j].tobytes() + k[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]
        yield pa.record_batch({"bucket": pa.array(bucket[cut].astype(np.int32)), "packed": pa.array(raw, pa.binary()), "sure": pa.nulls(len(cut), pa.binary())})


def _unpacked(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    width = int(kind[1])
    n = len(raw) // (width + 8)
    return np.frombuffer(raw, kind, n), np.frombuffer(raw, np.int64, n, n * width)


def _buckets(kind: str, close):
    """From rows sorted by bucket: what ``close(token, key)`` makes of the entries whose token has several keys."""

    def made(bucket, packed):
        t, k = (np.concatenate(x) for x in zip(*(_unpacked(x, kind) for x in packed), strict=True))
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        once = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        t, k = t[once], k[once]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.concatenate([first, [len(t)]]))
        several = np.repeat((size > 1) | (k[first] == 0), size) & (k != 0)
        t, k = t[several], k[several]
        return close((t.astype(_U) << _U(32)) | _U(bucket) if kind == "u4" else t, k)

    def of(batches):
        now, packed = None, []
        for b in batches:
            for bucket, raw, sure in zip(b["bucket"].to_pylist(), b["packed"].to_pylist(), b["sure"].to_pylist(), strict=True):
                if sure is not None:
                    yield close(*_unpacked(sure, "u8"))
                    continue
                if bucket != now:
                    if packed:
                        yield made(now, packed)
                    now, packed = bucket, []
                packed.append(raw)
        if packed:
            yield made(now, packed)

    return of


def _dealt(packed: DataFrame, kind: str, close, schema: str) -> DataFrame:
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(kind, close), schema)


def shared_windows(rows: DataFrame, size: int) -> DataFrame:
    """(tk, n_windows) of the texts (tk, text) of one row with windows that another text holds, each counted once.

    ``size``: anchors of all, about.  For texts of several rows n_windows says nothing.
    """
    buckets = max(64, size // BUCKET)

    def strings(batches):
        out = _Packer(buckets, "u4")
        for b in batches:
            for part in slices(b):
                r, core, *_ = anchors(*sequence(part["text"]), LENGTH, GRAM)
                yield from out.add(core.view(_U), np.asarray(part["tk"])[r])
        yield from out.flush()

    def named(t, k):
        return pa.record_batch({"tk": pa.array(k), "token": pa.array(t.view(np.int64))})

    hot = _dealt(rows.select("tk", "text").mapInArrow(strings, _PACKED), "u4", named, "tk bigint, token bigint")
    hot = stage(hot.groupBy("tk").agg(F.collect_set("token").alias("hot")), "hot-strings")
    met = rows.select("tk", "text").join(small(hot, MAX_BROADCAST_ROWS, F.size("hot")), "tk")
    window_buckets = max(64, (hot.agg(F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()[0]) * LENGTH // 2 // BUCKET)

    def windows(batches):
        out = _Packer(window_buckets, "u8")
        for b in batches:
            for part in slices(b):
                prefix, offsets = sequence(part["text"])
                r, core, _, s, e, _ = anchors(prefix, offsets, LENGTH, GRAM)
                lists = part["hot"]
                row = np.repeat(np.arange(len(part)), np.asarray(pa.compute.list_value_length(lists), np.int64))
                token = lambda t, r: mix(t ^ mix(r.astype(_U)))  # noqa: E731  a row's own
                core = _Packer(buckets, "u4").named(core.view(_U))
                keep = np.isin(token(core, r), token(np.asarray(lists.flatten()).view(_U), row))
                r, s, e = r[keep], s[keep], e[keep]
                n = e - s + 1
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[r] + s, n)
                yield from out.add(span_hash(prefix, start, start + LENGTH), np.asarray(part["tk"])[np.repeat(r, n)])
        yield from out.flush()

    def counted(t, k):
        key, n = np.unique(k, return_counts=True)
        return pa.record_batch({"tk": pa.array(key), "n": pa.array(n.astype(np.int64))})

    found = _dealt(met.select("tk", "text", "hot").mapInArrow(windows, _PACKED), "u8", counted, "tk bigint, n bigint")
    return found.groupBy("tk").agg(F.sum("n").alias("n_windows"))
