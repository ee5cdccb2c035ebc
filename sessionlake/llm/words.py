"""Words of Arrow string columns as numpy arrays of positions and 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D. Texts are read from Arrow's buffers, so no
Python string is made for each word. Work proceeds in chunks of about a megabyte of text, whatever
the size of a batch or of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; words beyond LONG bytes are told apart by a digest.
CHUNK, LONG = 1 << 20, 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each text (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` bytes in all; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def segment(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's first word (one more entry than texts)."""
    inside = ~_SPACE[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, as one number (beyond the end: zeros)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _block(window: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next 8 bytes of words of which `left` bytes are left."""
    out = window[at]
    short = np.flatnonzero(left < 8)
    out[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    return out


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length; of words beyond LONG bytes, a BLAKE2 digest."""
    size = ends - starts
    out, lo = mix(size.astype(np.uint64) * _BASE), 0
    while lo < len(starts):  # stretches, so that one very long text needs no more memory than others
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        first, plain = int(starts[lo]), np.flatnonzero(size[lo:hi] <= LONG) + lo
        if len(plain):
            window = windows(data[first : int(ends[plain[-1]])])
            for done in range(0, LONG, 8):
                plain = plain[size[plain] > done]
                if not len(plain):
                    break
                out[plain] = mix(out[plain] ^ _block(window, starts[plain] - first + done, size[plain] - done))
        lo = hi
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words of equal size (at most LONG bytes) at `at` in a and `other` in b, both windows, have equal bytes."""
    out, left = np.ones(len(size), bool), np.arange(len(size))
    for done in range(0, LONG, 8):
        left = left[size[left] > done]
        if not len(left):
            break
        differ = _block(a, at[left] + done, size[left] - done) != _block(b, other[left] + done, size[left] - done)
        out[left[differ]] = False
    return out


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes as they are."""
    return _LOWER[data]
