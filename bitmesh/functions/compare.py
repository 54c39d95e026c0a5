"""Comparison of blocks of codes in numpy, as Spark's Python workers run it.

A block is a run of codes as three byte strings: ids, which of them are null,
and the 64-bit words, one word's column after the other. The functions here go
to the executors by value, so nothing has to be installed there but numpy and
pyarrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows and columns of a tile that is compared at once, which caches hold; candidates that are listed at once; pairs in a batch.
TILE_ROWS, TILE_COLS, LISTED, BATCH = 64, 4096, 1 << 20, 1 << 17
#: A bucket with more candidates than this is compared as a tile, smaller ones are listed together.
TILE_FROM = 1 << 12
#: From this share of all pairs on, comparing all of them costs less than looking for candidates.
ALL_FROM = 0.7


def pack(batches, names: list[str]):
    """All rows of a partition as one block."""
    ids, gone, words, block = [], [], [[] for _ in names], None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block")[0].as_py() if block is None else block
        own = batch.column("id")
        ids.append(own.fill_null(0).to_numpy(zero_copy_only=False))
        gone.append(own.is_null().to_numpy(zero_copy_only=False))
        for have, name in zip(words, names, strict=True):
            have.append(batch.column(name).to_numpy(zero_copy_only=False))
    if ids:
        rows = {"block": [block], "ids": [np.concatenate(ids).tobytes()], "gone": [np.concatenate(gone).tobytes()], "words": [b"".join(np.concatenate(w).tobytes() for w in words)]}
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("gone", pa.binary()), ("words", pa.binary())]))


def unpack(batch, row: int):
    """ids, nulls and words (a row for each word) of a block."""
    ids, gone, words = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("ids", np.int64), ("gone", np.bool_), ("words", np.uint64)))
    return ids, gone, words.reshape(-1, len(ids))


class Distances:
    """Distances of tiles, in memory that is used again."""

    def __init__(self, n_words: int):
        kind = np.uint8 if n_words < 4 else np.uint16
        self.xor, self.dist, self.one, self.near = (np.empty(TILE_ROWS * TILE_COLS, t) for t in (np.uint64, kind, np.uint8, np.bool_))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = a.shape[1], b.shape[1]
        xor, dist, one = (x[: shape[0] * shape[1]].reshape(shape) for x in (self.xor, self.dist, self.one))
        for w, (x, y) in enumerate(zip(a, b, strict=True)):
            np.bitwise_xor(x[:, None], y[None, :], out=xor)
            np.bitwise_count(xor, out=dist if not w else one)
            if w:
                np.add(dist, one, out=dist)
        return dist

    def hits(self, a: np.ndarray, b: np.ndarray, k: int):
        """Places in a, places in b and distances of all pairs within k, tile by tile."""
        for p in range(0, a.shape[1], TILE_ROWS):
            for q in range(0, b.shape[1], TILE_COLS):
                dist = self.of(a[:, p : p + TILE_ROWS], b[:, q : q + TILE_COLS])
                near = np.less_equal(dist, k, out=self.near[: dist.size].reshape(dist.shape))
                if len(at := np.flatnonzero(near)):
                    x, y = np.divmod(at, dist.shape[1])
                    yield x + p, y + q, dist.ravel()[at].astype(np.int32)

    def counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of pairs at each distance."""
        out = np.zeros(64 * len(a) + 1, np.int64)
        for p in range(0, a.shape[1], TILE_ROWS):
            for q in range(0, b.shape[1], TILE_COLS):
                out += np.bincount(self.of(a[:, p : p + TILE_ROWS], b[:, q : q + TILE_COLS]).ravel(), minlength=len(out))
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of codes in equal places."""
    return np.bitwise_count(a ^ b).sum(axis=0, dtype=np.int32)


def chunk_keys(words: np.ndarray, mask: dict[int, int]) -> np.ndarray:
    """A number for each code's bits of a chunk. Chunks of several words are mixed, so that different bits seldom have one number; up to 16 bits are put together, which sorts fast."""
    if len(mask) == 1 and next(iter(mask.values())).bit_count() <= 16:
        ((w, m),) = mask.items()
        out, filled = np.zeros(words.shape[1], np.uint16), 0
        while m:
            low = (m & -m).bit_length() - 1
            run = ((m >> low) + 1 & ~(m >> low)).bit_length() - 1
            ones = (1 << run) - 1
            out |= ((words[w] >> np.uint64(low) & np.uint64(ones)) << np.uint64(filled)).astype(np.uint16)
            m &= ~(ones << low)
            filled += run
        return out
    out = None
    for w, m in sorted(mask.items()):
        part = words[w] & np.uint64(m)
        out = part if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ part
    return out


def runs(keys: np.ndarray):
    """Order by key, and first place and length of each key's run in it."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order, sorted_[first], first, np.diff(np.r_[first, len(keys)])


def buckets(a: np.ndarray, b: np.ndarray, mask: dict[int, int]):
    """Orders of both by a chunk, and for each key that both have the places and lengths of its runs."""
    order_a, keys_a, at_a, n_a = runs(chunk_keys(a, mask))
    order_b, keys_b, at_b, n_b = runs(chunk_keys(b, mask))
    _, x, y = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
    return order_a, order_b, at_a[x], n_a[x], at_b[y], n_b[y]


def listed(at_a, n_a, at_b, n_b):
    """Places of all pairs of many small buckets, a bounded number at a time."""
    ends = np.cumsum(n_a * n_b)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LISTED, "right")))
        own = slice(start, stop)
        sizes = (n_a * n_b)[own]
        which = np.repeat(np.arange(stop - start), sizes)
        place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield at_a[own][which] + place // n_b[own][which], at_b[own][which] + place % n_b[own][which]
        start = stop


def agree(a: np.ndarray, b: np.ndarray, mask: dict[int, int]) -> np.ndarray:
    out = np.ones(a.shape[1], np.bool_)
    for w, m in mask.items():
        out &= (a[w] ^ b[w]) & np.uint64(m) == 0
    return out


def within(a: np.ndarray, b: np.ndarray, k: int, masks: list[dict[int, int]] | None):
    """Places and distances of the pairs within k that agree in a chunk, each pair once; without chunks, of all within k."""
    made = Distances(len(a))
    if masks is not None:
        found = [buckets(a, b, m) for m in masks]
        if sum(float((n_a * n_b).sum()) for *_, n_a, _, n_b in found) < ALL_FROM * a.shape[1] * b.shape[1]:
            for pos, (order_a, order_b, at_a, n_a, at_b, n_b) in enumerate(found):
                for x, y, dist in bucket_hits(a, b, k, made, order_a, order_b, at_a, n_a, at_b, n_b):
                    # a pair belongs to the first chunk in which it agrees
                    fits = agree(a[:, x], b[:, y], masks[pos])
                    for m in masks[:pos]:
                        fits &= ~agree(a[:, x], b[:, y], m)
                    yield x[fits], y[fits], dist[fits]
            return
    for x, y, dist in made.hits(a, b, k):
        if masks is not None:
            fits = np.zeros(len(x), np.bool_)
            for m in masks:
                fits |= agree(a[:, x], b[:, y], m)
            x, y, dist = x[fits], y[fits], dist[fits]
        yield x, y, dist


def bucket_hits(a, b, k, made, order_a, order_b, at_a, n_a, at_b, n_b):
    large = n_a * n_b > TILE_FROM
    left, right = np.ascontiguousarray(a[:, order_a]), np.ascontiguousarray(b[:, order_b])
    for s, n, t, m in zip(at_a[large], n_a[large], at_b[large], n_b[large], strict=True):
        for x, y, dist in made.hits(left[:, s : s + n], right[:, t : t + m], k):
            yield order_a[x + s], order_b[y + t], dist
    small = ~large
    for x, y in listed(at_a[small], n_a[small], at_b[small], n_b[small]):
        dist = distances(left[:, x], right[:, y])
        near = dist <= k
        yield order_a[x[near]], order_b[y[near]], dist[near]


PAIRS = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("dist", pa.int32())])
COUNTS = pa.schema([("dist", pa.int32()), ("pairs", pa.int64())])


def cells(batches):
    """Both blocks of each cell: the same twice where a block meets itself."""
    waiting: dict[int, tuple] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            cell, side, alone = (batch.column(c)[row].as_py() for c in ("cell", "side", "alone"))
            block = unpack(batch, row)
            if alone:
                yield block, block, True
            elif cell in waiting:
                other = waiting.pop(cell)
                yield *((other, block) if side else (block, other)), False
            else:
                waiting[cell] = block


def hit_pairs(left, right, alone: bool, k: int, masks, own: bool):
    """Ids, nulls and distances of a cell's pairs; of a table with itself, each pair once with the smaller id first."""
    (ids_a, gone_a, a), (ids_b, gone_b, b) = left, right
    for x, y, dist in within(a, b, k, masks):
        i, j = ids_a[x], ids_b[y]
        if not own:
            yield i, j, gone_a[x], gone_b[y], dist
            continue
        keep = i < j if alone else i != j
        i, j, dist = i[keep], j[keep], dist[keep]
        yield np.minimum(i, j), np.maximum(i, j), None, None, dist


def pair_batches(batches, k: int, masks, own: bool):
    """``i, j, dist`` of the cells of a partition."""
    for left, right, alone in cells(batches):
        have, rows = [], 0
        for part in hit_pairs(left, right, alone, k, masks, own):
            have.append(part)
            rows += len(part[-1])
            if rows >= BATCH:
                yield from pair_batch(have)
                have, rows = [], 0
        yield from pair_batch(have)


def pair_batch(have: list[tuple]):
    if have:
        i, j, no_i, no_j, dist = (None if c[0] is None else np.concatenate(c) for c in zip(*have, strict=True))
        for at in range(0, len(dist), BATCH):
            cut = slice(at, at + BATCH)
            yield pa.RecordBatch.from_arrays([pa.array(c[cut], t, mask=None if no is None else no[cut]) for c, t, no in ((i, pa.int64(), no_i), (j, pa.int64(), no_j), (dist, pa.int32(), None))], schema=PAIRS)


def count_batches(batches, k: int, masks, own: bool, bits: int):
    """``dist, pairs`` of the cells of a partition: numbers of pairs, which are never listed where all count."""
    total = np.zeros(bits + 1, np.int64)
    for left, right, alone in cells(batches):
        (ids_a, _, a), (ids_b, _, b) = left, right
        if k < bits:
            for *_, dist in hit_pairs(left, right, alone, k, masks, own):
                total += np.bincount(dist, minlength=len(total))
            continue
        here = Distances(len(a)).counts(a, b)[: len(total)]
        if own:  # rows of one id are no pair
            order_a, order_b, at_a, n_a, at_b, n_b = buckets(ids_a.view(np.uint64)[None], ids_b.view(np.uint64)[None], {0: (1 << 64) - 1})
            for x, y in listed(at_a, n_a, at_b, n_b):
                here -= np.bincount(distances(a[:, order_a[x]], b[:, order_b[y]]), minlength=len(here))
            here = here // 2 if alone else here
        total += here
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], schema=COUNTS)
