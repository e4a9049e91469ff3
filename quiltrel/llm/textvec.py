"""Vectorised word hashing over a batch of texts as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each; a longer single text makes its own range."""
    lo, size = 0, 0
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :] if batch.num_rows else np.zeros(1, np.int32)
    for i in range(batch.num_rows):
        n = int(offsets[i + 1]) - int(offsets[i])
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if batch.num_rows > lo:
        yield lo, batch.num_rows


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, text starts, word starts, word ends, text of each word); texts are joined by one blank."""
    buf = np.frombuffer(b" ".join([b"", *raws]) + b" " * 9, np.uint8)
    starts = np.zeros(len(raws), np.int64)
    np.cumsum([len(r) + 1 for r in raws[:-1]], out=starts[1:])
    starts += 1
    black = ~_BLANK[buf]
    turns = np.flatnonzero(black[1:] != black[:-1]) + 1
    first, last = turns[0::2], turns[1::2]
    return buf, starts, first, last, np.searchsorted(starts, first, "right") - 1


def hash_spans(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[first:last]; the buffer ends in 8 spare bytes at least."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    size = last - first
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    live = np.arange(len(first))
    at, left = first, size
    while len(live):
        part = eight[at] & _MASK[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ (part * U(0x9E3779B97F4A7C15)))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    return h


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every k consecutive words of one text."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    n = len(h) - k + 1
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(0x9E3779B97F4A7C15) + mix(h[j : j + n] + U(j))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, mix(out[at])
