"""Synthetic codes: numpy versions with fixed seeds, and Spark versions for any number of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitmesh.functions.codes import from_words, n_words


def uniform(n: int, d_bytes: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (n, d_bytes), np.uint8)


def clustered(n: int, d_bytes: int, centroids: int = 10, dup_fraction: float = 0.1, noise_bits: int = 5, seed: int = 1) -> np.ndarray:
    """Uniform codes of which a fraction are copies of the first few with some bits flipped; the same bit may flip twice."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 256, (n, d_bytes), np.uint8)
    rows = rng.choice(n - centroids, copies, replace=False) + centroids if (copies := int((n - centroids) * dup_fraction)) > 0 else np.zeros(0, np.int64)
    # numbers are drawn row by row, as the published counts need it; rows are made from them all at once
    drawn = [(rng.integers(0, centroids), rng.integers(0, 8 * d_bytes, max(1, int(rng.poisson(noise_bits))))) for _ in rows]
    out[rows] = out[[head for head, _ in drawn]]
    places = np.concatenate([p for _, p in drawn]) if drawn else np.zeros(0, np.int64)
    np.bitwise_xor.at(out, (np.repeat(rows, [len(p) for _, p in drawn]), places // 8), (1 << places % 8).astype(np.uint8))
    return out


def low_entropy(n: int, d_bytes: int, constant: float = 0.5, seed: int = 2) -> np.ndarray:
    """Random leading bytes, the rest zero."""
    out = np.zeros((n, d_bytes), np.uint8)
    lead = int(d_bytes * (1.0 - constant))
    if lead > 0:
        out[:, :lead] = np.random.default_rng(seed).integers(0, 256, (n, lead), np.uint8)
    return out


def with_duplicates(n: int, d_bytes: int, dup_fraction: float = 0.01, seed: int = 3) -> np.ndarray:
    """Uniform codes, some overwritten by others, one after the other."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 256, (n, d_bytes), np.uint8)
    origin = np.arange(n)
    for source, target in rng.integers(0, n, (int(n * dup_fraction), 2)).tolist():
        origin[target] = origin[source]
    return out[origin]


def xorshift_bytes(n: int, d_bytes: int, seed: int) -> np.ndarray:
    """Bytes of an xorshift64* generator, one step each."""
    state, out = seed & (2**64 - 1), bytearray()
    for _ in range(n * d_bytes):
        state ^= (state << 13) & (2**64 - 1)
        state ^= state >> 7
        state ^= (state << 17) & (2**64 - 1)
        out.append((state * 2685821657736338717 & (2**64 - 1)) >> 56)
    return np.frombuffer(out, np.uint8).reshape(n, d_bytes)


def spark_uniform(spark: SparkSession, n: int, d_bytes: int, seed: int = 0) -> DataFrame:
    """``id, code`` of n hashed rows, made on the executors."""
    words = [F.xxhash64("id", F.lit(seed), F.lit(i)) for i in range(n_words(d_bytes))]
    if d_bytes % 8:
        words[-1] = words[-1].bitwiseAND(F.lit((1 << 8 * (d_bytes % 8)) - 1).cast("bigint"))
    return spark.range(n).select("id", from_words(words, d_bytes).alias("code"))


def spark_clustered(spark: SparkSession, n: int, d_bytes: int, centroids: int = 10, dup_fraction: float = 0.1, noise_bits: int = 5, seed: int = 1) -> DataFrame:
    """Like ``clustered``, made on the executors: the noise is the xor of as many single bits."""
    m = n_words(d_bytes)
    share = F.lit(int(dup_fraction * (1 << 20)))
    copy = (F.col("id") >= centroids) & (F.pmod(F.xxhash64("id", F.lit(seed), F.lit("copy")), F.lit(1 << 20)) < share)
    origin = F.when(copy, F.pmod(F.xxhash64("id", F.lit(seed), F.lit("of")), F.lit(centroids))).otherwise(F.col("id"))
    words = [F.xxhash64(origin, F.lit(seed), F.lit(i)) for i in range(m)]
    for j in range(noise_bits):
        bit = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("noise"), F.lit(j)), F.lit(8 * d_bytes)).cast("int")
        words = [F.when(copy & (F.floor(bit / 64) == i), w.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit % 64))).otherwise(w) for i, w in enumerate(words)]
    if d_bytes % 8:
        words[-1] = words[-1].bitwiseAND(F.lit((1 << 8 * (d_bytes % 8)) - 1).cast("bigint"))
    return spark.range(n).select("id", from_words(words, d_bytes).alias("code"))


def split_in_half(codes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows below n // 2, and the others with ids from 0 on again."""
    half = n // 2
    return codes.where(F.col("id") < half), codes.where(F.col("id") >= half).withColumn("id", F.col("id") - half)
