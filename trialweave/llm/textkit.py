"""Vectorised text helpers shared by the corpus operators.

Everything here works on one Arrow batch at a time inside a Spark task: numpy passes over the concatenated
UTF-8 bytes, no per-character Python.  Spark decides how the batches are partitioned and shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
#: Odd multipliers of the polynomial and mixing hashes (arbitrary, fixed so that every executor agrees).
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

_powers: dict[str, np.ndarray] = {"fwd": np.ones(1, _U), "inv": np.ones(1, _U)}


def _pow(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base (or its inverse) modulo 2**64."""
    have = _powers[which]
    if len(have) < n:
        m = max(n, 2 * len(have))
        steps = np.full(m, _U(_BASE if which == "fwd" else _INV), _U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        _powers[which] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _MIX1
        h = (h ^ (h >> _U(27))) * _MIX2
        return h ^ (h >> _U(31))


def batch_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of data[k] * base**k for i <= k < j (modulo 2**64)."""
    out = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(_U) + _U(1)) * _pow("fwd", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of the bytes of each span [start, end); equal bytes give equal hashes wherever they lie."""
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * _pow("inv", len(prefix))[start]
        return mix(h + (end - start).astype(_U) * _U(_BASE))


def _table(separators) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0x20
    return t


#: A-Z to lower case; the separators of the two word rules to a space.
SPACE_WORDS = _table([0x20, *range(0x09, 0x0E)])
ALNUM_WORDS = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Lower-cased bytes, word starts and ends, and the n+1 offsets of each row's words.

    No word crosses a row: the row ends cut like separators do.
    """
    low = table[data]
    inside = low != 0x20
    before = np.empty(len(low), bool)
    after = np.empty(len(low), bool)
    if len(low):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(low)]] = False
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(low), starts, ends)


def row_of(counts_offsets: np.ndarray, n_items: int) -> np.ndarray:
    """The row number of each item, from the n+1 offsets."""
    return np.repeat(np.arange(len(counts_offsets) - 1), np.diff(counts_offsets))


def shingles(hashes: np.ndarray, word_offsets: np.ndarray, k: int):
    """(row, hash) of the shingles of ``k`` words; a row of fewer words, but not none, has one of all its words."""
    n = len(hashes)
    rows = len(word_offsets) - 1
    counts = np.diff(word_offsets)
    row = row_of(word_offsets, n)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, n - k + 1), _U)
        for j in range(k):
            full += hashes[j : n - k + 1 + j] * _pow("fwd", k + 1)[j + 1] if n >= k else _U(0)
        keep = np.zeros(len(full), bool)
        if len(full):
            keep = row[: len(full)] == row[k - 1 :]
        out_row, out_hash = row[: len(full)][keep], mix(full[keep] + _U(k))
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            hs = np.zeros(len(short), _U)
            for j in range(k - 1):
                has = counts[short] > j
                hs[has] += hashes[word_offsets[short[has]] + j] * _pow("fwd", k + 1)[j + 1]
            out_row = np.concatenate([out_row, short])
            out_hash = np.concatenate([out_hash, mix(hs + counts[short].astype(_U))])
    del rows
    return out_row, out_hash


def distinct_by_row(row: np.ndarray, value: np.ndarray, n_rows: int):
    """Values distinct and ascending inside each row, and the n+1 offsets."""
    if len(row) and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    at = np.searchsorted(row, np.arange(n_rows + 1))
    parts = [np.unique(value[at[i] : at[i + 1]]) for i in range(n_rows)]
    sizes = np.fromiter(map(len, parts), np.int64, n_rows)
    return (np.concatenate(parts) if parts else value[:0]), np.concatenate([[0], np.cumsum(sizes)])


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 19):
    """Sub-batches whose text takes about ``max_bytes`` (one longer row alone), so that numpy's copies stay bounded."""
    text = batch[column]
    sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0), np.int64))
    at = 0
    while at < len(batch):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + max_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit key of each row's set of distinct hashes; equal sets, equal keys."""
    n = np.diff(offsets)
    out = np.zeros(len(n), _U)
    full = n > 0
    if full.any():
        with np.errstate(over="ignore"):
            s = np.concatenate([[_U(0)], np.cumsum(mix(values ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
            out = s[offsets[1:]] - s[offsets[:-1]]
            out = mix(out + mix(n.astype(_U)))
    return out
