"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``, which on
UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``. Words are located and hashed with
vector operations over a slice of documents, so Python never loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes handled at once; one longer document is a slice of its own.
SLICE_BYTES = 4 << 20
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (works in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_strings(column) -> pa.Array:
    """One plain string array; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` text bytes each."""
    _, offsets = text_bytes(column)
    begin, n = 0, len(column)
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


class Words:
    """Word spans and hashes of some documents.

    ``start`` and ``end`` are byte positions in ``data``; ``first[i]`` is the
    index of document i's first word, ``doc`` the document of each word.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = text_bytes(column)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        size = len(data)
        solid = (data != 0x20) & (data - np.uint8(0x09) > 4)  # below 9 it wraps
        fresh = np.zeros(size + 1, dtype=bool)
        fresh[self.offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | fresh[1:size]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | fresh[1:size]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, seed)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    out = mix(length.astype(np.uint64) * _ODD + np.uint64(seed * 2 + 1))
    out = mix((out ^ (eight[start] & _LOW_BYTES[np.minimum(length, 8)])) * _STEP + _ODD)
    some, done = np.flatnonzero(length > 8), 8
    while len(some):
        left = length[some] - done
        part = eight[start[some] + done] & _LOW_BYTES[np.minimum(left, 8)]
        out[some] = mix((out[some] ^ part) * _STEP + _ODD)
        done += 8
        some = some[left > 8]
    return out


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` words, built by doubling: two windows of
    one length side by side make one of twice the length."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    base = (0x9E3779B97F4A7C15 + 2 * seed * 0xD1B54A32D192ED03) % (1 << 64) | 1
    power = {1: words}
    span = 1
    while span * 2 <= width:
        low = power[span]
        step = np.uint64(pow(base, span, 1 << 64))
        power[span * 2] = low[:-span] * step + low[span:]
        span *= 2
    total, have = power[span], span
    for span in sorted(power, reverse=True)[1:]:
        if have + span <= width:
            step = np.uint64(pow(base, span, 1 << 64))
            n = len(words) - have - span + 1
            total = total[:n] * step + power[span][have:have + n]
            have += span
    return mix(total + np.uint64(width))
