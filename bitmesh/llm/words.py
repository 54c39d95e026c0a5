"""Vectorised word scanning over Arrow string buffers.

Texts stay in one contiguous byte buffer; word borders, word hashes and
shingle hashes are found by whole-array numpy operations, without a Python
object per word. Memory is a small multiple of one Arrow batch.

A hash has 64 bits. Two different words (or shingles) of one comparison
collide with a chance near 2**-64 per pair, which the operators accept.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEGMENT_BYTES = 1 << 19
_BASE = 0x9E6C63D0876A3F35  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes that end a word of the kind ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of the kind ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower case.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Marks that may be taken off a word, and letters of one byte.
MARKS, LETTERS = np.zeros(256, bool), np.zeros(256, bool)
MARKS[[*b".,;:!?"]] = True
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Bytes beyond ASCII and Latin-1 letters, and the one that special tokens begin with.
RARE = np.zeros(256, bool)
RARE[[0x3C, 0xC2, *range(0xC4, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lets a worker give its free memory back to the system when a task ends; else it keeps it while it waits."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


class Words(NamedTuple):
    """Words of a batch of texts, in order: byte borders in ``buf``, 64-bit hashes, and ``first[i]:first[i + 1]`` for text i."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("up", ())) < n:
        _cache["up"], _cache["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _cache["up"], _cache["down"]


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, one after the other, and their n + 1 borders. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, borders, data = texts.buffers()
    offsets = np.frombuffer(borders, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def _peel(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Takes a mark off the end of each word where a Latin letter stands before it, as a word of its own."""
    last, prev, first = part[end - 1], part[np.maximum(end - 2, 0)], part[np.maximum(end - 3, 0)]
    loose = MARKS[last] & (end - start >= 2) & (LETTERS[prev] | ((end - start >= 3) & (first == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7)))
    times = 1 + loose
    place = np.cumsum(times)[loose] - 1
    cut = end[loose] - 1
    start, end = np.repeat(start, times), np.repeat(end, times)
    start[place], end[place - 1] = cut, cut
    return start, end


def scan(texts: pa.Array | pa.ChunkedArray, ends: np.ndarray = SPACE, fold: np.ndarray = LOWER, peel: bool = False, unfolded: np.ndarray | None = None) -> Words:
    """Words of each text: the longest runs of bytes not in ``ends``, hashed after ``fold``.

    With ``peel``, a mark after a word's last letter is a word of its own.
    Words with a byte of ``unfolded`` are hashed as they are.
    """
    buf, offsets = text_buffer(texts)
    inner = ~ends
    border = offsets[1:-1]
    starts, stops, codes = [], [], []
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + SEGMENT_BYTES)
        if to < n:  # a segment ends after a separator or at a text's border
            back = np.flatnonzero(ends[buf[at:to]])
            near = np.searchsorted(border, to, "right")
            cut = max(at + int(back[-1]) + 1 if len(back) else 0, int(border[near - 1]) if near else 0)
            while cut <= at:
                more = min(n, to + SEGMENT_BYTES)
                ahead = np.flatnonzero(ends[buf[to:more]])
                near = np.searchsorted(border, to, "left")
                cut = min(to + int(ahead[0]) + 1 if len(ahead) else (n if more == n else more + 1), int(border[near]) if near < len(border) else n)
                if cut > more:
                    to, cut = more, 0
            to = cut
        part = buf[at:to]
        word = inner[part]
        left, right = np.empty_like(word), np.empty_like(word)
        left[0], right[-1] = False, False
        left[1:], right[:-1] = word[:-1], word[1:]
        a, b = np.searchsorted(offsets, [at, to])
        own = offsets[a:b] - at
        left[own[own < to - at]] = False
        right[own[own > 0] - 1] = False
        s, e = np.flatnonzero(word & ~left), np.flatnonzero(word & ~right) + 1
        if peel and len(s):
            s, e = _peel(part, s, e)
        up, down = _power_tables(to - at + 1)
        total = np.empty(to - at + 1, U64)
        total[0] = 0
        np.cumsum(_TABLE[fold][part] * up[: to - at], out=total[1:])
        code = (total[e] - total[s]) * down[s]
        if unfolded is not None and (rare := unfolded[part]).any():
            np.cumsum(_TABLE[part] * up[: to - at], out=total[1:])
            seen = np.r_[0, np.cumsum(rare)]
            code = np.where(seen[e] > seen[s], (total[e] - total[s]) * down[s], code)
        codes.append(mix(code + (e - s).astype(U64)))
        starts.append(s + at)
        stops.append(e + at)
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(buf, offsets, start, join(stops, np.int64), join(codes, U64), np.searchsorted(start, offsets))


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_runs(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text, repeated ones too, and the number of their text.

    A text with fewer words than ``size``, but not none, has one shingle: its whole sequence.
    """
    counts = np.diff(words.first)
    run = np.zeros(max(len(words.code) - size + 1, 0), U64)
    for k in range(size):
        run += mix(words.code[k : k + len(run)] + U64(2 * k + 1)) * U64(2 * k + 3)
    own = np.maximum(counts - size + 1, 0)
    keep = np.repeat(words.first[:-1] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    code, text = mix(run[keep]), np.repeat(np.arange(len(own)), own)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = mix(counts[short].astype(U64))
        for k in range(size - 1):
            more = counts[short] > k
            at = words.first[short[more]] + k
            whole[more] = mix(whole[more] * U64(31) ^ words.code[at])
        code, text = np.concatenate([code, whole]), np.concatenate([text, short])
    return code, text


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their n + 1 borders."""
    code, text = shingle_runs(words, size)
    if len(text) and (text[1:] < text[:-1]).any():  # short texts come last there
        order = np.argsort(text, kind="stable")
        code, text = code[order], text[order]
    borders = np.searchsorted(text, np.arange(len(words.first))).tolist()
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        code[a:b].sort()
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    code, text = code[new], text[new]
    return code, np.searchsorted(text, np.arange(len(words.first)))
