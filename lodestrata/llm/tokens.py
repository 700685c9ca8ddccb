"""Token ids of whole Arrow columns by the tokenizers library.

A byte-level BPE encodes each pre-token by itself, so a pre-token needs encoding once only. Pre-tokens are found for a
whole column by numpy, hashed, and looked up in a table of bounded size, whose bytes are compared with the
pre-token's before its ids are taken; the library encodes those that aren't there or that differ. Texts with characters beyond the blocks whose classes are settled go to the library whole. The ids are the library's.
"""

from __future__ import annotations

import os
from functools import cache
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa

from lodestrata.llm.words import ODD, SLICE, column_bytes, mix, resident

#: log2 of the table's slots, and ids and bytes of text that it holds before it starts anew.
SLOTS, HELD, WRITTEN = 21, 6_000_000, 20_000_000
#: Blocks of characters whose classes don't depend on the version of Unicode.
SETTLED = ((0x0, 0x530), (0x1E00, 0x1F00), (0x2000, 0x2060), (0x20A0, 0x20BE), (0x2190, 0x2300), (0x3000, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
#: Unicode's White_Space.
BLANK = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, DIGIT, SPACE, OTHER, UNSETTLED = 1, 2, 3, 4, 5
#: Words that are encoded as one text.
JOINED = 4000


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, UNSETTLED, np.uint8)
    for a, b in SETTLED:
        out[a:b] = [{"L": LETTER, "N": DIGIT}.get(category(chr(c))[0], UNSETTLED if category(chr(c)) == "Cn" else OTHER) for c in range(a, b)]
    out[list(BLANK)] = SPACE
    return out


@cache
def _values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * ODD)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    q = 0x5851F42D4C957F2B
    each = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, dtype=np.uint64)]), dtype=np.uint64)
    return each(q), each(pow(q, -1, 1 << 64))


_arange = cache(lambda n: np.arange(n, dtype=np.int32))


def _places(n: int) -> np.ndarray:
    return _arange(max(SLICE, 1 << (n - 1).bit_length()))[:n]


def pretoken_starts(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First characters of the pre-tokens of texts (at off in cps) by the pattern of byte-level BPE:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(cps)
    kind = _classes()[cps]
    head = np.zeros(n + 1, bool)
    head[off] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    start[n] = True
    runs = np.flatnonzero(start)
    first, end = runs[:-1], runs[1:]
    # Blanks before something else: the last one stands by itself or, if it is a space, with what follows.
    e = end[(kind[first] == SPACE) & ~head[end]]
    space = cps[e - 1] == 0x20
    start[e - 1] = True
    start[e[space]] = False
    # Contractions: an apostrophe alone between texts' other runs, before letters.
    q = first[(end - first == 1) & (cps[first] == 0x27) & start[first] & ~head[end]]
    if len(q):
        q = q[kind[q + 1] == LETTER]
        a = cps[q + 1]
        b = np.where((q + 2 < n) & ~head[np.minimum(q + 2, n)], cps[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[q[one | two] + 1] = False
        start[q[one] + 2] = True
        start[q[two] + 3] = True
    return np.flatnonzero(start[:n])


def _appended(pool: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    if used + len(more) > len(pool):
        pool = np.concatenate([pool[:used], np.zeros(max(used // 2, len(more)) + len(more), pool.dtype)])
    pool[used : used + len(more)] = more
    return pool, used + len(more)


class Encoder:
    """ids(column) for string columns."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # a byte-level token has a character for each byte
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(1 << SLOTS, np.uint64)
        self.at = np.zeros(1 << SLOTS, np.int64)
        self.size = np.zeros(1 << SLOTS, np.int32)
        self.text = np.zeros(1 << SLOTS, np.int64)  # where a pre-token's bytes begin
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.raw, self.written = np.zeros(1 << 16, np.uint8), 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Appends ids to the pool; where each pre-token's begin."""
        at = self.used + np.cumsum(size) - size
        self.pool, self.used = _appended(self.pool, self.used, flat)
        return at

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library(words)
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def _joined(self, words: list[str], width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that begin with a space before letters: they stay apart in a text of many; width: in bytes."""
        texts = ["".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        flat = np.fromiter(chain.from_iterable(self.library(texts)), np.int32)
        ends, to = np.cumsum(self.bytes[flat]), np.cumsum(width)
        last = np.searchsorted(ends, to)
        if len(flat) == 0 or ends[-1] != to[-1] or not np.array_equal(ends[last], to):
            return self._each(words)
        return flat, np.diff(last, prepend=-1)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        buf, off = column_bytes(column)
        ids, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        a = 0
        while a < len(off) - 1:  # so many whole texts at once
            b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
            i, c = self._ids(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            ids.append(i)
            count.append(c)
            a = b
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(count))])

    def _ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        text = raw.tobytes().decode()
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = (raw & 0xC0) != 0x80
        coff = np.concatenate([[0], np.cumsum(lead)])[off]
        odd = np.add.reduceat(np.append(_classes()[cps] == UNSETTLED, False).astype(np.int64), coff[:-1])
        odd[coff[1:] == coff[:-1]] = 0
        if self.used > HELD or self.written > WRITTEN:
            self.clear()
        start = pretoken_starts(cps, coff)
        end = np.append(start[1:], len(cps))
        length = end - start
        byte = np.append(np.flatnonzero(lead)[start], len(raw))
        width = np.diff(byte)
        up, down = _powers(max(SLICE, 1 << (len(cps) - 1).bit_length()))
        h = mix(np.add.reduceat(_values()[cps] * up[: len(cps)], start) * down[start] + length.astype(np.uint64)) | np.uint64(1)
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        at, size, kept = self.at[slot], self.size[slot].astype(np.int64), self.text[slot]
        miss = np.flatnonzero(self.hash[slot] != h)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            spaced = (cps[start[one]] == 0x20) & (end[one] - start[one] > 1)
            spaced[spaced] = _classes()[cps[start[one[spaced]] + 1]] == LETTER
            new_at, new_size, n = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), width[one]
            new_text = self.written + np.cumsum(n) - n
            self.raw, self.written = _appended(self.raw, self.written, raw[np.repeat(byte[one] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
            for use in (spaced, ~spaced):
                if use.any():
                    s, e = start[one[use]], end[one[use]]
                    words = [text[x:y] for x, y in zip(s.tolist(), e.tolist())]
                    flat, new_size[use] = self._joined(words, n[use]) if use is spaced else self._each(words)
                    new_at[use] = self._keep(flat, new_size[use])
            self.hash[slot[one]], self.at[slot[one]], self.size[slot[one]], self.text[slot[one]] = h[one], new_at, new_size, new_text
            # Of several that want one slot the last was kept; all fields come from the same one.
            at[miss], size[miss], kept[miss] = new_at[back], new_size[back], new_text[back]
        same = np.repeat((kept - byte[:-1]).astype(np.int32), width)
        same += _places(len(raw))
        other = np.flatnonzero(self.raw.take(same, mode="clip") != raw)
        if len(other):
            wrong = np.unique(np.searchsorted(byte, other, "right") - 1)
            flat, size[wrong] = self._each([text[x:y] for x, y in zip(start[wrong].tolist(), end[wrong].tolist())])
            at[wrong] = self._keep(flat, size[wrong])
        total = int(size.sum())
        before = np.cumsum(size) - size
        ids = self.pool[np.repeat(at - before, size) + np.arange(total)]
        token = np.searchsorted(start, coff)
        count = np.append(before, total)[token]
        count = count[1:] - count[:-1]
        if odd.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            bad = np.flatnonzero(odd)
            for i, found in zip(bad.tolist(), self.library([text[coff[i] : coff[i + 1]] for i in bad.tolist()])):
                parts[i] = np.array(found, np.int32)
            return np.concatenate(parts).astype(np.int32), np.array([len(x) for x in parts], np.int64)
        return ids, count


def encoder(path: str) -> Encoder:
    return resident(path, lambda: Encoder(path))


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    return np.insert(ids, off[1:], end_id).astype(np.int32), off + np.arange(len(off))
