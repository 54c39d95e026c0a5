"""Approximate and nearest-neighbour searches, and how much of the truth they find."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitmesh.functions import codes as C
from bitmesh.operators.pairs import _empty, _joined, _width
from bitmesh.plans.chunks import Plan
from bitmesh.sources.shared import stored


def sampled_bits(d_bytes: int, tables: int, bits: int, seed: int = 0) -> list[list[int]]:
    """For each hash table the bit positions that make its key."""
    draw = random.Random(seed)
    return [sorted(draw.sample(range(8 * d_bytes), min(bits, 8 * d_bytes))) for _ in range(tables)]


def lsh_pairs(codes: DataFrame, k: int, tables: int = 1, bits: int = 16, seed: int = 0, d_bytes: int | None = None) -> DataFrame:
    """Pairs within k that share a bucket of bit-sampling hash tables: a subset of all pairs, each once.

    The tables are chunks that may overlap; a pair belongs to the first table in which it meets.
    """
    width = _width(codes, None, d_bytes)
    if not width:
        return _empty(codes)
    words = C.to_words(codes, width)
    return _joined(words, words, Plan(width, tuple(map(tuple, sampled_bits(width, tables, bits, seed)))), k, True)


def multi_probe_pairs(codes: DataFrame, k: int, bits: int = 16, flips: int = 0, d_bytes: int | None = None) -> DataFrame:
    """Pairs within k whose first ``bits`` bits differ in at most ``flips`` places: one table whose buckets are probed with all patterns of flips."""
    from itertools import combinations

    width = _width(codes, None, d_bytes)
    bits = min(bits, 62, 8 * width)
    if not width:
        return _empty(codes)
    if not flips:
        words = C.to_words(codes, width)
        return _joined(words, words, Plan(width, (tuple(range(bits)),)), k, True)
    names = C.word_names(width)
    word_bits = min(64, 8 * width)
    masks = [sum(1 << (word_bits - 1 - p) for p in some) for n in range(flips + 1) for some in combinations(range(bits), n)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    key = C.extract_bits([F.col(n) for n in names], 0, bits, width)[0]
    words = C.to_words(codes, width)
    flipped = F.transform(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>"), lambda m: F.col("key").bitwiseXOR(m))
    asked = words.select("id", *names, key.alias("key")).select("id", *names, F.explode(flipped).alias("key"))
    a, b = asked.alias("a"), words.select("id", *names, key.alias("key")).alias("b")
    dist = C.hamming([F.col(f"a.{n}") for n in names], [F.col(f"b.{n}") for n in names]).cast("int")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (dist <= k))
    return met.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), dist.alias("dist"))


def multi_index_pairs(codes: DataFrame, k: int, bits: int | None = None, d_bytes: int | None = None) -> DataFrame:
    """Pairs within k by max(k + 1, 2) keys of at most 32 leading bits of equal chunks: exact, though the keys leave bits out."""
    width = _width(codes, None, d_bytes)
    count = max(k + 1, 2)
    size = bits or max(1, min(32, 8 * width // count))
    plan = Plan(width, tuple(tuple(range(i * size, (i + 1) * size)) for i in range(count)))
    words = C.to_words(codes, width)
    return _joined(words, words, plan, k, True)


def nearest(queries: DataFrame, codes: DataFrame, count: int, k: int | None = None) -> DataFrame:
    """``query_id, id, dist, place``: the ``count`` nearest codes of each query, by distance and id, and within k if that is given.

    Chunk joins find them: within k, or within radii that double until a query
    has enough. Beyond the radius at which a chunk has too few bits to part
    the codes, the queries that are still open, a stated set, are compared
    with every code.
    """
    from bitmesh.operators.pairs import _nested, find_pairs_within

    width = _width(queries, codes)
    order = Window.partitionBy("i").orderBy("dist", "j")
    ranked = lambda pairs: pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).select(F.col("i").alias("query_id"), F.col("j").alias("id"), "dist", "place")
    if k is not None or not width:
        return ranked(find_pairs_within(queries, k or 0, codes))
    n = codes.count()
    parts, open_, radius = [], queries, 1
    while 8 * width // (radius + 1) >= math.log2(n + 1):
        found = stored(ranked(find_pairs_within(open_, radius, codes, d_bytes=width)))
        full = found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= min(count, n)).select("query_id")
        parts.append(found.join(full, "query_id", "left_semi"))
        open_ = open_.join(full, open_["id"] == full["query_id"], "left_anti")
        radius *= 2
    parts.append(ranked(_nested(C.to_words(open_, width), C.to_words(codes, width), width, 8 * width, False)))
    return reduce(DataFrame.unionByName, parts)


def nearest_pairs(codes: DataFrame, k: int, count: int = 50, d_bytes: int | None = None) -> DataFrame:
    """Pairs i < j within k where one is among the other's ``count`` nearest others; only codes within k are looked at."""
    from bitmesh.operators.pairs import find_pairs_within

    pairs = stored(find_pairs_within(codes, k, d_bytes=d_bytes))  # read in both directions
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    top = both.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))).where(F.col("place") <= count)
    return top.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist").distinct()


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``found, truth, common, recall`` of two pair tables; recall is null if there is no truth."""
    f, t = (table.select("i", "j", F.lit(own).alias("f"), F.lit(not own).alias("t")) for table, own in ((found, True), (truth, False)))
    both = f.unionByName(t).groupBy("i", "j").agg(F.max("f").alias("f"), F.max("t").alias("t"))  # one shuffle makes each table distinct and sets one beside the other
    sums = both.agg(F.count_if("f").alias("found"), F.count_if("t").alias("truth"), F.count_if(F.col("f") & F.col("t")).alias("common"))
    return sums.withColumn("recall", F.when(F.col("truth") > 0, F.col("common") / F.col("truth")))
