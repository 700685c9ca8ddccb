"""Word and shingle hashes of Arrow string columns, by whole-column numpy operations."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # bytes of text that are hashed at once
ODD = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def class_table(separators: bytes) -> np.ndarray:
    """True for bytes of words. Bytes of characters beyond ASCII are always of words."""
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: Words [^\x20\x09-\x0D]+
BLANKS = class_table(b" \t\n\x0b\x0c\r")
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text in lower case
ALNUM = class_table(bytes(c for c in range(128) if not (48 <= c < 58 or 97 <= c < 123)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _weights(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * ODD) | np.uint64(1)


def place_weights(n: int) -> np.ndarray:
    """An odd random factor for each of n places. Sums of value times factor tell strings apart whatever their pattern; powers
    of one base wouldn't, modulo 2^64."""
    return _weights(max(1 << 12, 1 << (n - 1).bit_length()))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _pieces(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that end at the end of a text or, inside a long one, at a separator."""
    at, end = 0, len(buf)
    while at < end:
        to = at + SLICE
        if to >= end:
            to = end
        else:
            cut = off[np.searchsorted(off, to, "right") - 1]
            if cut > at:
                to = int(cut)
            else:
                stop = int(off[np.searchsorted(off, to, "left")])  # end of the long text
                while to < stop:
                    gap = np.flatnonzero(~word[buf[to : min(stop, to + SLICE)]])
                    if len(gap):
                        to += int(gap[0])
                        break
                    to = min(stop, to + SLICE)
        yield at, to
        at = to


def word_hashes(buf: np.ndarray, off: np.ndarray, word: np.ndarray, spans: bool = False):
    """Hashes of the words of each text in lower case (A to Z only), and the number of words before each text.

    With spans also each word's first byte and the byte after its last, in buf.
    """
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _pieces(buf, off, word):
        low = LOWER[buf[a:b]]
        of = np.concatenate([[False], word[low], [False]])
        first, last = of[1:-1] & ~of[:-2], of[1:-1] & ~of[2:]
        inner = off[np.searchsorted(off, a, "right") : np.searchsorted(off, b, "left")] - a
        first[inner] = of[1:-1][inner]
        last[inner[inner > 0] - 1] = of[1:-1][inner[inner > 0] - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        starts.append(s + a)
        ends.append(e + a)
        if len(s):
            at, n = np.flatnonzero(of[1:-1]), e - s
            place = at - np.repeat(s, n)
            value = BYTES[low[at]] * place_weights(int(n.max()))[place]
            hashes.append(mix(np.add.reduceat(value, np.cumsum(n) - n) + n.astype(np.uint64) * ODD))
    starts = np.concatenate(starts)
    counts = np.searchsorted(starts, off, "left")
    if spans:
        return np.concatenate(hashes), counts, starts, np.concatenate(ends)
    return np.concatenate(hashes), counts


@cache
def _factors(n: int) -> np.ndarray:
    return mix(np.arange(n * 1000 + 7, n * 1000 + 7 + n, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, also across texts."""
    f = _factors(n)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * f[0]
    for i in range(1, n):
        out += h[i : i + m] * f[i]
    return mix(out)


def short_hash(h: np.ndarray) -> np.ndarray:
    """Hash of a whole text of fewer words than a shingle has."""
    return mix(np.array([np.sum(h * _factors(len(h)), dtype=np.uint64)], dtype=np.uint64))


def text_shingles(column: pa.Array, word: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of n words, sorted by hash; one of all words where there are fewer."""
    buf, off = column_bytes(column)
    h, count = word_hashes(buf, off, word)
    all_ = shingle_hashes(h, n)
    for a, b in zip(count[:-1].tolist(), count[1:].tolist()):
        if b - a >= n:
            s = np.sort(all_[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield short_hash(h[a:b])
        else:
            yield np.zeros(0, np.uint64)


def slices(batches, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to rows of about so many bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


_resident: dict[str, object] = {}


def resident(name: str, make):
    """What make returns, kept in this process until something else is: workers live on through stages, so one large table
    at a time."""
    if name not in _resident:
        _resident.clear()
        _resident[name] = make()
    return _resident[name]


def lean(run, keeps: str | None = None):
    """run for mapInArrow, giving freed memory back to the system: workers are kept for further stages. Of what other
    stages left in the process only keeps stays."""
    def go(batches):
        for name in [n for n in _resident if n != keeps]:
            del _resident[name]
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass
    return go
