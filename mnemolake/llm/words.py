"""Vectorised word and line hashing over Arrow string batches.

A *word* is a longest run of ASCII letters and digits, compared without case.
All functions work on the UTF-8 bytes of a whole batch with a handful of NumPy
passes, so the cost per byte does not depend on the number of documents, and a
batch is cut into segments of bounded size to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes (fixed values).
BYTE_MUL = 0x9E3779B97F4A7C15
WORD_MUL = 0xD6E8FEB86659FD93
SEGMENT_BYTES = 2 << 20
_MASK = (1 << 64) - 1

_LUT = np.zeros(256, np.uint8)
_LUT[48:58] = np.arange(48, 58)
_LUT[97:123] = np.arange(97, 123)
_LUT[65:91] = np.arange(97, 123)

_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BYTE_MUL and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, SEGMENT_BYTES + 1)
        inverse = pow(BYTE_MUL, -1, 1 << 64)
        _POW = np.full(size, BYTE_MUL, np.uint64)
        _INV = np.full(size, inverse, np.uint64)
        _POW[0] = _INV[0] = 1
        np.multiply.accumulate(_POW, out=_POW)
        np.multiply.accumulate(_INV, out=_INV)
    return _POW[:n], _INV[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of codes (uint8)."""
    pow_, inv = _powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * pow_[:-1], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(WORD_MUL))


def text_segments(texts: pa.Array | pa.ChunkedArray, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `limit` bytes.

    Null texts appear as empty ones. A text longer than `limit` is a segment of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        last = min(max(last, row + 1), len(texts))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the row's index of each word, and the words' byte spans."""
    code = _LUT[data]
    inside = code != 0
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = begins[begins > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return span_hashes(code, starts, ends), doc, starts, ends


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries (rows are not respected)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(WORD_MUL) + hashes[j : j + n]
    return mix(g)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row index and length in bytes of every line that holds more than white space.

    Lines end at line feed or carriage return; outer blanks and tabs are not part of a line.
    """
    ink = (data > 32)
    brk = (data == 10) | (data == 13)
    begins = offsets[:-1][offsets[:-1] < len(data)]
    new = np.zeros(len(data) + 1, bool)
    new[1:] = brk
    new[begins] = True
    line_of = np.cumsum(new[:-1]) - 1
    at = np.flatnonzero(ink)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(np.diff(line_of[at])) + 1
    starts = at[np.r_[0, change]]
    ends = at[np.r_[change - 1, len(at) - 1]] + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return span_hashes(data, starts, ends), doc, ends - starts
