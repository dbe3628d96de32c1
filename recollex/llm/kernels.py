"""Word hashing over Arrow string columns, on their bytes and without a Python object for each word.

A word is a run of bytes outside space and tab..carriage return; all of these are single bytes in UTF-8, so bytes and
code points give the same words. A word's hash is a polynomial over random values of its bytes, taken from prefix
sums modulo 2^64, then mixed. It depends on the word alone, not on its place, text or batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Words of letters and digits only; every byte of a character beyond ASCII belongs to one.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, SLICE_BYTES + 1)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size > 8 * SLICE_BYTES:
            return held
        _powers[base] = held
    return held


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset at which each begins, and the end; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `most` bytes; a longer text stands alone."""
    raw, off = text_bytes(texts)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_bounds(raw: np.ndarray, off: np.ndarray, of: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text the index of its first word, and the end.

    of: for each byte whether it belongs to words.
    """
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    inside = of[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span; spans ascend and each piece of SLICE_BYTES is done by itself."""
    out = np.zeros(len(starts), dtype=np.uint64)
    values, at = _BYTE_LOWER if lower else _BYTE, 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, side="right")))
        piece = raw[lo : int(ends[to - 1])]
        v = values[piece] * _power(_BASE, len(piece))[: len(piece)]
        total = np.empty(len(piece) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(v, out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (total[e] - total[s]) * _power(_INVERSE, len(piece))[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of values[start:end] for each range, from prefix sums."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values))[: len(values)], out=total[1:])
    found = (total[ends] - total[starts]) * _power(_INVERSE, len(values) + 1)[starts]
    return mix(found + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive entries of words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(h)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows, of a stream sorted by its first columns, that agree in these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        if held and (key[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(at, to - at))
            if to < len(key):
                yield pa.Table.from_batches(held)
                held = []
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def release() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """out, and at its end release(): a worker waits for its next task."""
    try:
        yield from out
    finally:
        release()
