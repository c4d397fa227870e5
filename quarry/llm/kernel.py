"""Vectorised word kernel: the words of whole texts as 64-bit hashes, straight from Arrow buffers.

A word is a maximal run of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased; every byte of a multi-byte UTF-8 character counts as a word byte, so runs can be found
on bytes. No word is ever built as a Python string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=np.uint8)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = 1
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_LONG = 256
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(32))


def pieces(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) over slices of about max_bytes; one longer text is a slice of its own."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = offsets(arr)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1)
        yield at, arr.slice(at, to - at)
        at = to


def offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if len(arr) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array; a null is an empty text."""
    if arr.null_count:
        arr = pa.concat_arrays([arr.fill_null("")])
    offs = offsets(arr)
    buf = arr.buffers()[2] if len(arr) else None
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ones in a byte mask, cut where texts end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= inside[:-1] ^ 1
    last[:-1] &= inside[1:] ^ 1
    edge = offs[:-1][offs[:-1] < len(inside)]
    first[edge] = inside[edge]
    edge = offs[1:][offs[1:] > 0] - 1
    last[edge] = inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix((eight[starts] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    more, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(more):
        left = np.minimum(size[more] - k, 8)
        h[more] = mix(h[more] * U(0xFF51AFD7ED558CCD) ^ (eight[starts[more] + k] & _KEEP[left]))
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, n + 1 word offsets of the texts)."""
    data, offs = raw(arr)
    starts, ends = runs(_WORD[data], offs)
    return hash_runs(_LOWER[data], starts, ends), np.searchsorted(starts, offs)


def grams(h: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words, and their offsets; a text of fewer words, but not none, has one run."""
    count = np.diff(offs)
    made = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    to = np.concatenate([[0], np.cumsum(made)])
    total = int(to[-1])
    where = np.arange(total) + np.repeat(offs[:-1] - to[:-1], made)
    last = np.repeat(offs[1:], made)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        at = where + k
        real = at < last
        step = np.where(real, h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else U(0), U(0))
        out = out * U(0x100000001B3) + step + U(k + 1) * real.astype(np.uint64)
    return mix(out), to


def rows_of(offs: np.ndarray) -> np.ndarray:
    """The text each element belongs to."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))
