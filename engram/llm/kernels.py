"""NumPy kernels over Arrow text: words, shingles and rolling hashes of many documents at once.

A text is its UTF-8 bytes; null counts as empty. Words are maximal runs of bytes other than space
and 0x09-0x0D, with A-Z lower-cased. All hashes are 64 bit and modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base (``up``) or of its inverse (``down``)."""
    known = _powers[kind]
    if len(known) < n:
        step = np.full(max(n, PIECE), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = known = np.cumprod(step)
    return known[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running hash; entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power("up", len(data)), out=out[1:])
    return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of documents in order, and where each document's words begin."""
    begin, end = int(offsets[0]), int(offsets[-1])
    body = data[begin:end]
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[body]
    cut = np.zeros(n + 1, bool)  # a document begins here, or the texts end
    cut[offsets - begin] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (cut[:-1] | ~before))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (cut[1:] | ~after)) + 1
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), PIECE // 8):
        s, e = starts[i : i + PIECE // 8], ends[i : i + PIECE // 8]
        part = body[s[0] : e[-1]]
        running = prefix_hash(_LOWER[part] if lower else part)
        down = power("down", len(part))
        out[i : i + len(s)] = mix((running[e - s[0]] - running[s - s[0]]) * down[s - s[0]] + (e - s).astype(np.uint64))
    return out, np.searchsorted(starts, offsets - begin)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five-word shingles with repeats, and where each document's begin.

    A text of one to four words is one shingle; one without words has none.
    """
    hashes, at = words(data, offsets)
    counts = np.diff(at)
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    if not len(hashes):
        return hashes, to
    step = np.uint64(0xD6E8FEB86659FD93)
    keep = np.zeros(len(hashes), bool)
    full = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= WORDS:
        span = hashes[: len(hashes) - WORDS + 1].copy()
        for j in range(1, WORDS):
            span *= step
            span += hashes[j : len(hashes) - WORDS + 1 + j]
        full[: len(span)] = span
        keep[:] = True
        for k in range(WORDS - 1):
            tail = at[1:] - 1 - k
            keep[tail[tail >= at[:-1]]] = False
    for d in np.flatnonzero((counts > 0) & (counts < WORDS)):
        value = np.uint64(counts[d])
        for x in hashes[at[d] : at[d + 1]]:
            value = (np.array([value]) * step + x)[0]
        full[at[d]], keep[at[d]] = ~value, True
    return mix(full[keep]), to


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each document, sorted."""
    hashes, at = shingles(data, offsets)
    return [np.unique(hashes[a:b]) if b > a else hashes[:0] for a, b in zip(at[:-1], at[1:])]


def as_lists(parts: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list column of 64-bit hashes."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
