"""Chunk plans for the pigeonhole rewrite: disjoint bit sets, one of which two codes at distance k must share if there are more than k."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: A key never takes more bits than this.
MAX_KEY_BITS = 128
SAMPLE_ROWS = 10_000


class UnsupportedRegime(ValueError):
    """The radius is too large for the chunks of this path."""

    def __init__(self, k: int, d_bytes: int, limit: int):
        super().__init__(f"k={k} is not supported for codes of {d_bytes} bytes on this path: k must be under {limit}")
        self.k, self.d_bytes = k, d_bytes


def is_supported(k: int, d_bytes: int) -> bool:
    return 0 <= k < d_bytes


def is_supported_bit(k: int, d_bytes: int) -> bool:
    return 0 <= k < 8 * d_bytes


def check(k: int, d_bytes: int, bits: bool) -> None:
    """Raises ValueError for a width below 1, a negative radius, or one that the path can't serve."""
    if d_bytes < 1:
        raise ValueError("codes must have at least one byte")
    if k < 0:
        raise ValueError("k must not be negative")
    if not (is_supported_bit if bits else is_supported)(k, d_bytes):
        raise UnsupportedRegime(k, d_bytes, 8 * d_bytes if bits else d_bytes)


def _edges(total: int, parts: int) -> list[tuple[int, int]]:
    cuts = [i * total // parts for i in range(parts + 1)] if parts > 0 else []
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def chunk_boundaries(n_bytes: int, n_chunks: int) -> list[tuple[int, int]]:
    """Byte ranges of nearly equal size; empty ones are left out."""
    return _edges(n_bytes, n_chunks)


def chunk_bit_boundaries(d_bits: int, n_chunks: int) -> list[tuple[int, int]]:
    """Bit ranges of nearly equal size; empty ones are left out."""
    return _edges(d_bits, n_chunks)


def bit_chunks_for(d_bits: int, k: int) -> list[tuple[int, int]]:
    """Bit ranges for radius k: more than k, none over 128 bits; for k = 0 a prefix is enough."""
    if k == 0 and d_bits > MAX_KEY_BITS:
        return [(0, MAX_KEY_BITS)]
    return chunk_bit_boundaries(d_bits, max(k + 1, math.ceil(d_bits / MAX_KEY_BITS), 1))


def bit_entropies(sample: np.ndarray) -> np.ndarray:
    """Entropy of each bit over a sample of codes, (rows, bytes) uint8, most significant bit first."""
    if not len(sample):
        return np.zeros(8 * sample.shape[1])
    p = np.unpackbits(sample, axis=1).mean(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
    return np.where((p <= 0) | (p >= 1), 0.0, h)


def plan_adaptive_chunks(entropies: np.ndarray | list[float], n_chunks: int, max_bits: int = MAX_KEY_BITS) -> list[list[int]]:
    """Deals informative bits out to chunks of nearly equal total entropy, the most informative first; constant bits are left out."""
    bits = sorted((p for p, h in enumerate(entropies) if h > 0), key=lambda p: -entropies[p])
    chunks: list[list[int]] = [[] for _ in range(n_chunks)]
    load = [0.0] * n_chunks
    for p in bits:
        open_ = [c for c in range(n_chunks) if len(chunks[c]) < max_bits]
        if not open_:
            break
        c = min(open_, key=lambda c: (load[c], c))
        chunks[c].append(p)
        load[c] += entropies[p]
    return [sorted(c) for c in chunks]


#: What Spark sets aside in each JVM before anything runs, in MB, and bytes that a row of a shuffle takes beside its fields.
RESERVED_MB, ROW_BYTES = 300, 16


def estimate_memory_mb(n: int, d_bytes: int, k: int, methods: list[str]) -> float:
    """What the joins of the methods bring to a shuffle at most, in MB over the whole cluster, beside what a JVM reserves.

    A chunk join shuffles a row for each code and chunk, with id, words, chunk
    number and key, on two sides that a self-join's exchange is reused for at
    best; a method without chunks sends each code once.
    """
    words = math.ceil(d_bytes / 8)
    total = 0
    for name in methods:
        whole = "brute" in name.lower()
        bits = "byte" not in name.lower()
        plan = Plan(d_bytes, (tuple(range(8 * d_bytes)),)) if whole else Plan.from_bits(d_bytes, k) if bits else Plan.from_bytes(d_bytes, k)
        keys = 0 if whole else 1 + max(map(len, plan.masks()))
        total += 2 * n * len(plan.chunks) * (ROW_BYTES + 8 * (1 + words + keys))
    return RESERVED_MB + total / 2**20


@dataclass(frozen=True)
class Plan:
    """Chunks as bit positions, over codes of d_bytes."""

    d_bytes: int
    chunks: tuple[tuple[int, ...], ...]

    @classmethod
    def from_bytes(cls, d_bytes: int, k: int) -> Plan:
        return cls(d_bytes, tuple(tuple(range(8 * a, 8 * b)) for a, b in chunk_boundaries(d_bytes, k + 1)))

    @classmethod
    def from_bits(cls, d_bytes: int, k: int) -> Plan:
        if k == 0:  # equal codes agree in all words, which makes the sharpest key
            return cls(d_bytes, (tuple(range(8 * d_bytes)),))
        return cls(d_bytes, tuple(tuple(range(a, b)) for a, b in bit_chunks_for(8 * d_bytes, k)))

    @classmethod
    def adaptive(cls, d_bytes: int, k: int, entropies: np.ndarray) -> Plan:
        """By entropy; if that leaves a chunk empty, by plain bit ranges."""
        chunks = plan_adaptive_chunks(entropies, k + 1)
        if k == 0 or not all(chunks):
            return cls.from_bits(d_bytes, k)
        return cls(d_bytes, tuple(map(tuple, chunks)))

    def masks(self) -> list[dict[int, int]]:
        """For each chunk the mask of each 64-bit word that it touches; a short last word is right-aligned."""
        out = []
        for chunk in self.chunks:
            own: dict[int, int] = {}
            for p in chunk:
                word = p // 64
                width = min(64, 8 * self.d_bytes - 64 * word)
                own[word] = own.get(word, 0) | 1 << (width - 1 - p % 64)
            out.append(own)
        return out

    def candidates(self, sample: np.ndarray) -> float:
        """How many candidate pairs a table has for each squared row, judged by a sample's buckets."""
        if len(sample) < 2:
            return 0.0
        bits = np.unpackbits(sample, axis=1)
        total = 0.0
        for chunk in self.chunks:
            packed = np.ascontiguousarray(np.packbits(bits[:, list(chunk)], axis=1))
            _, counts = np.unique(packed, axis=0, return_counts=True)
            total += float((counts.astype(float) * (counts - 1)).sum()) / 2
        return total / (len(sample) * (len(sample) - 1) / 2)
