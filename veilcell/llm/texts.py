"""Words of whole texts as numpy arrays, for the tasks of ``mapInArrow``.

A word is a maximal run of digits, letters a-z (A-Z are lowered) and characters
beyond ASCII. UTF-8 codes the latter in bytes from 0x80 on, so bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes hashed at once
CHUNK = 4 << 20  # bytes of text handled at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_powers_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers_cache.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE + (1 << 16))
        up, down = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
        if size > 4 * PIECE:  # one enormous word: not worth keeping
            return up, down
        _powers_cache["up"], _powers_cache["down"] = up, down
    return _powers_cache["up"], _powers_cache["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or len(offsets) < 2:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, at least one row each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and where the words of each text begin."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[filled] = inside[filled]
    ends = np.append(filled[1:], len(data)) - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # pieces of whole words
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + PIECE)))
        lo, hi = starts[a], stops[b - 1]
        up, down = _tables(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, stops[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * down[s]
        a = b
    return mix(out), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words; runs across texts are the caller's to leave out."""
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
    return mix(total)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` columns of sorted rows, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i) for i in range(keys)]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        bounds = [*np.flatnonzero(cut).tolist(), batch.num_rows]
        begin = 0
        for end in bounds:
            key = tuple(c[begin].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last, begin = key, end
    if held:
        yield pa.Table.from_batches(held)
