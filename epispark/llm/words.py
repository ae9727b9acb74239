"""Words of whole texts as arrays: which text, and a 64-bit hash each.

A batch's bytes are cut at delimiters, so the memory taken does not depend on how long a
text is. The hash of a word is a polynomial in its bytes modulo 2**64, read off running
sums for all words at once and mixed afterwards; it is the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18
SLICE = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes inside a word, after A-Z became a-z: anything but white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes inside a word, after A-Z became a-z: a-z, 0-9 and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables["up"], _tables["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; a null text is an empty one."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(sizes)] if len(sizes) else [0]
    for lo, hi in zip(edges, edges[1:]):
        yield batch.slice(lo, hi - lo)


def _segments(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = int(offsets[np.searchsorted(offsets, lo + SEGMENT, side="right") - 1])
        if hi <= lo:
            stop = int(offsets[np.searchsorted(offsets, lo, side="right")])
            hi = min(lo + SEGMENT, stop)
            while hi < stop:
                gaps = np.flatnonzero(~inside[_LOWER[data[hi : min(hi + 4096, stop)]]])
                if len(gaps):
                    hi += int(gaps[0])
                    break
                hi = min(hi + 4096, stop)
        yield lo, hi
        lo = hi


def hashed_words(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, in text order: the row of its text, and its hash."""
    rows, _, (hashes,) = placed_words(offsets, data, inside)
    return rows, hashes


def placed_words(
    offsets: np.ndarray, data: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each word, in text order: the row of its text, the place of its first byte in
    ``data``, its hash, and one for each of its first ``prefixes`` bytes (0 for a shorter word)."""
    rows, places, hashes = [], [], [[] for _ in (0, *prefixes)]
    for lo, hi in _segments(offsets, data, inside):
        part = _LOWER[data[lo:hi]]
        held = inside[part]
        before = np.empty_like(held)
        before[0] = False
        before[1:] = held[:-1]
        bounds = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        before[bounds] = False
        starts = np.flatnonzero(held & ~before)
        if not len(starts):
            continue
        after = np.empty_like(held)
        after[-1] = False
        after[:-1] = held[1:]
        after[bounds[bounds > 0] - 1] = False
        ends = np.flatnonzero(held & ~after)
        up, down = _power_tables(len(part))
        sums = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])
        first, scale = np.where(starts > 0, sums[starts - 1], np.uint64(0)), down[starts]
        hashes[0].append(mix((sums[ends] - first) * scale))
        for k, size in enumerate(prefixes, 1):
            cut = np.minimum(starts + size - 1, ends)
            start = mix((sums[cut] - first) * scale + np.uint64(size))
            hashes[k].append(np.where(ends - starts >= size - 1, start, np.uint64(0)))
        places.append(starts + lo)
        rows.append((np.searchsorted(offsets, starts + lo, side="right") - 1).astype(np.int32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in hashes]
    return np.concatenate(rows), np.concatenate(places), [np.concatenate(h) for h in hashes]


def word_ranges(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` texts begins in the list of words, and the end."""
    return np.searchsorted(rows, np.arange(n + 1, dtype=rows.dtype))


def shingles(rows: np.ndarray, hashes: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``size`` words; a text of fewer words is one run."""
    total = len(rows)
    starts = word_ranges(rows, n)
    counts = np.diff(starts)
    full = counts >= size
    place = np.arange(total) - starts[rows] if total else np.zeros(0, np.int64)
    begins = full[rows] & (place <= counts[rows] - size) if total else np.zeros(0, bool)
    at = np.flatnonzero(begins)
    out = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k])
    short = np.flatnonzero(~full & (counts > 0))
    few = counts[short].astype(np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        few[has] = mix(few[has] * np.uint64(0xD6E8FEB86659FD93) + hashes[starts[short[has]] + k])
    row = np.concatenate([rows[at], short.astype(rows.dtype)])
    value = np.concatenate([out, few])
    order = np.argsort(row, kind="stable")
    return row[order], value[order]
