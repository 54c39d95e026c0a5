"""Exact Hamming self-joins and cross joins as equi-joins on chunk keys.

``hamming(a, b) <= k`` alone would be a nested-loop join. Among more than k
disjoint chunks of bits, two codes at distance k agree in one at least, so the
join runs on (chunk number, chunk bits). A pair that agrees in several chunks
is emitted for the first of them only: no duplicates arise and no distinct is
needed. Where chunks are so short that a row meets many others in them, blocks
of rows meet instead (``blocks``), with the same result.

Inputs are DataFrames with a BIGINT-like ``id`` and a BINARY ``code``, all of
one width. Outputs are ``i, j, dist`` (self: i < j; cross: i from the first
table). Rows with the same id pair like any others, but never when i < j fails.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitmesh.functions import codes as C
from bitmesh.operators.blocks import block_counts, block_pairs
from bitmesh.plans.chunks import SAMPLE_ROWS, Plan, bit_entropies, check, is_supported_bit

SCHEMA = "i bigint, j bigint, dist int"
#: With more expected candidates for each row, blocks meet. A join side with more rows is never broadcast. Up to so many pairs Spark's nested loop compares all.
MOST_CANDIDATES, MOST_BROADCAST, NESTED_PAIRS = 1.0, 200_000, 1 << 24


def _width(a: DataFrame, b: DataFrame | None = None, d_bytes: int | None = None) -> int:
    """Width of the codes in bytes, 0 if there are none. TypeError and ValueError for what can't be joined.

    Without ``d_bytes`` this reads the tables once. With it no code is read
    here; codes of another width stop the query that the join is part of.
    """
    C.require_binary(a)
    if b is not None:
        C.require_binary(b)
    if d_bytes is not None:
        return d_bytes
    width = C.code_width(a)
    if b is not None:
        other = C.code_width(b)
        if width and other and width != other:
            raise ValueError(f"codes have different widths: {width} and {other} bytes")
        width = width and other
    return width


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], SCHEMA)


def keys(words: list[Column], plan: Plan) -> list[list[Column]]:
    """Key columns of each chunk, filled up with zeros to the same number."""
    masks = plan.masks()
    most = max(map(len, masks))
    none = F.lit(0).cast("bigint")
    return [[C.masked(words[w], m) for w, m in sorted(own.items())] + [none] * (most - len(own)) for own in masks]


def exploded(codes: DataFrame, plan: Plan) -> DataFrame:
    """``id, w*, pos, k0, ...``: a row for each code and chunk."""
    names = C.word_names(plan.d_bytes)
    words = [F.col(n) for n in names]
    rows = [F.struct(F.lit(pos).alias("pos"), *[c.alias(f"k{i}") for i, c in enumerate(own)]) for pos, own in enumerate(keys(words, plan))]
    return codes.select("id", *names, F.inline(F.array(*rows)))


def first_agreeing(a: list[Column], b: list[Column], plan: Plan) -> Column:
    """The first chunk in which two codes agree; null if there is none."""
    out = None
    for pos, own in enumerate(plan.masks()):
        same = None
        for w, m in sorted(own.items()):
            one = C.masked(a[w].bitwiseXOR(b[w]), m) == 0
            same = one if same is None else same & one
        out = F.when(same, pos) if out is None else out.when(same, pos)
    return out


def _sizes(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """Numbers of rows, which tell how a join runs; of a table on files they take no scan."""
    n = left.count()
    return n, n if right is left else right.count()


def _candidates(rows: tuple[int, int], plan: Plan) -> float:
    """How many candidates a row has in chunks of bits that are all alike likely."""
    return rows[0] * rows[1] * sum(2.0 ** -len(c) for c in plan.chunks) / max(1, sum(rows))


def _joined(left: DataFrame, right: DataFrame, plan: Plan, k: int, own: bool) -> DataFrame:
    """The chunk join of two tables of words."""
    rows = _sizes(left, right)
    if _candidates(rows, plan) > MOST_CANDIDATES:
        return block_pairs(left, None if own else right, rows, plan.d_bytes, k, plan)
    a, b = exploded(left, plan).alias("a"), exploded(right, plan).alias("b")
    if min(rows) * len(plan.chunks) > MOST_BROADCAST:  # the optimizer takes a table for as small as its files, without the copies for each chunk
        b = b.hint("merge")
    names = C.word_names(plan.d_bytes)
    x, y = [F.col(f"a.{n}") for n in names], [F.col(f"b.{n}") for n in names]
    n_keys = max(len(m) for m in plan.masks())
    on = F.col("a.pos") == F.col("b.pos")
    for i in range(n_keys):
        on &= F.col(f"a.k{i}") == F.col(f"b.k{i}")
    if own:
        on &= F.col("a.id") < F.col("b.id")
    dist = C.hamming(x, y)
    on &= dist <= k
    if len(plan.chunks) > 1:
        on &= F.col("a.pos") == first_agreeing(x, y, plan)
    return a.join(b, on).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), dist.cast("int").alias("dist"))


def _self(codes: DataFrame, width: int, plan: Plan, k: int) -> DataFrame:
    words = C.to_words(codes, width)
    return _joined(words, words, plan, k, True)


def find_pairs_self(codes: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """All pairs i < j at distance k at most, by byte-aligned chunks; k must be under the width in bytes."""
    width = _width(codes, None, d_bytes)
    if not width:
        check(k, max(k, 0) + 1, False)
        return _empty(codes)
    check(k, width, False)
    return _self(codes, width, Plan.from_bytes(width, k), k)


def try_find_pairs_self(codes: DataFrame, k: int, d_bytes: int | None = None) -> tuple[DataFrame | None, ValueError | None]:
    """The pairs and no error, or no pairs and the error."""
    try:
        return find_pairs_self(codes, k, d_bytes), None
    except ValueError as e:
        return None, e


def find_pairs_self_bit(codes: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """All pairs by bit-aligned chunks; k must be under the width in bits."""
    width = _width(codes, None, d_bytes)
    if not width:
        check(k, max(k, 0) + 1, True)
        return _empty(codes)
    check(k, width, True)
    return _self(codes, width, Plan.from_bits(width, k), k)


def sample_codes(codes: DataFrame, width: int, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``rows`` codes, chosen by a hash of the id, as a (rows, width) uint8 matrix."""
    n = codes.count()
    stride = max(n // rows, 1)
    some = codes.where(F.pmod(F.xxhash64("id"), F.lit(stride)) == 0).select("code").limit(rows).collect()
    return np.frombuffer(b"".join(bytes(r["code"]) for r in some), np.uint8).reshape(-1, width)


def adaptive_plan(codes: DataFrame, width: int, k: int) -> Plan:
    return Plan.adaptive(width, k, bit_entropies(sample_codes(codes, width)))


def find_pairs_self_adaptive(codes: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """All pairs by chunks of equal entropy, which a bounded sample tells; constant bits take no part. The result is exact under any plan."""
    width = _width(codes, None, d_bytes)
    if not width:
        check(k, max(k, 0) + 1, True)
        return _empty(codes)
    check(k, width, True)
    plan = Plan.from_bits(width, k) if k == 0 else adaptive_plan(codes, width, k)
    return _self(codes, width, plan, k)


def choose_plan(codes: DataFrame, width: int, k: int) -> Plan:
    """Of the bit and the entropy plan the one that a bounded sample gives fewer candidates."""
    if k == 0:
        return Plan.from_bits(width, k)
    sample = sample_codes(codes, width)
    return min((Plan.from_bits(width, k), Plan.adaptive(width, k, bit_entropies(sample))), key=lambda p: p.candidates(sample))


def find_pairs_self_auto(codes: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """All pairs by the plan that seems cheapest."""
    width = _width(codes, None, d_bytes)
    if not width:
        return _empty(codes)
    check(k, width, True)
    return _self(codes, width, choose_plan(codes, width, k), k)


def gram_places(bits: int, k: int, q: int) -> list[int]:
    """Places of which k * q + 1 are enough: k differing bits touch k * q windows at most, so codes within k agree at one of any k * q + 1 places. Spread over the whole code."""
    every = bits - q + 1
    some = k * q + 1
    return sorted({i * (every - 1) // max(some - 1, 1) for i in range(some)})


def find_pairs_qgram_self(codes: DataFrame, k: int, q: int, d_bytes: int | None = None) -> DataFrame:
    """All pairs by their q-bit windows at equal places, of which codes at distance k share at least (bits - q + 1) - k * q.

    Only a prefix of k * q + 1 places is posted, one of which every such pair
    shares; a pair is taken at the first place where it agrees, if its
    distance allows. Where the bound is 0 or less, every pair is a candidate
    and the bit path is taken.
    """
    width = _width(codes, None, d_bytes)
    if not width:
        return _empty(codes)
    check(k, width, True)
    bits = 8 * width
    if not 1 <= q <= min(16, bits):
        raise ValueError(f"q must be from 1 to {min(16, bits)}, not {q}")
    if (bits - q + 1) - k * q <= 0:
        return find_pairs_self_bit(codes, k, width)
    plan = Plan(width, tuple(tuple(range(p, p + q)) for p in gram_places(bits, k, q)))
    return _self(codes, width, plan, k)


def find_pairs_brute(codes: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """All pairs by comparing each with each: the baseline that the other paths are checked against."""
    width = _width(codes, None, d_bytes)
    if not width:
        return _empty(codes)
    words = C.to_words(codes, width)
    return _all(words, words, width, k, True)


def _all(left: DataFrame, right: DataFrame, width: int, k: int, own: bool) -> DataFrame:
    """Each row against each, by blocks unless the tables are small."""
    rows = _sizes(left, right)
    if rows[0] * rows[1] <= NESTED_PAIRS:
        return _nested(left, right, width, k, own)
    return block_pairs(left, None if own else right, rows, width, k, None)


def _nested(left: DataFrame, right: DataFrame, width: int, k: int, own: bool) -> DataFrame:
    names = C.word_names(width)
    a, b = left.alias("a"), right.alias("b")
    dist = C.hamming([F.col(f"a.{n}") for n in names], [F.col(f"b.{n}") for n in names])
    on = dist <= k
    if own:
        on &= F.col("a.id") < F.col("b.id")
    return a.join(b, on).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), dist.cast("int").alias("dist"))


def _cross(a: DataFrame, b: DataFrame, k: int, bits: bool, d_bytes: int | None) -> DataFrame:
    width = _width(a, b, d_bytes)
    if not width:
        check(k, max(k, 0) + 1, bits)
        return _empty(a)
    check(k, width, bits)
    plan = Plan.from_bits(width, k) if bits else Plan.from_bytes(width, k)
    left = C.to_words(a, width)
    return _joined(left, left if b is a else C.to_words(b, width), plan, k, False)


def find_pairs_cross(a: DataFrame, b: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """All (i from a, j from b) at distance k at most, by byte-aligned chunks. Equal ids pair too."""
    return _cross(a, b, k, False, d_bytes)


def find_pairs_cross_bit(a: DataFrame, b: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """The same by bit-aligned chunks."""
    return _cross(a, b, k, True, d_bytes)


def find_pairs_cross_brute(a: DataFrame, b: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    width = _width(a, b, d_bytes)
    return _all(C.to_words(a, width), C.to_words(b, width), width, k, False) if width else _empty(a)


def find_pairs_within(a: DataFrame, k: int, b: DataFrame | None = None, return_distances: bool = True, d_bytes: int | None = None) -> DataFrame:
    """Self-join, or cross join if b is given, for any k from 0 on: chunks where they can be exact, else every pair."""
    if k < 0:
        raise ValueError("k must not be negative")
    width = _width(a, b, d_bytes)
    if not width:
        found = _empty(a)
    elif is_supported_bit(k, width):
        found = find_pairs_self_bit(a, k, width) if b is None else find_pairs_cross_bit(a, b, k, width)
    else:
        found = find_pairs_brute(a, k, width) if b is None else find_pairs_cross_brute(a, b, k, width)
    return found if return_distances else found.select("i", "j")


def count_pairs_within(codes: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """``dist, pairs``: how many pairs i < j have each distance up to k. Large tables are counted block by block, and no pair is sent."""
    if k < 0:
        raise ValueError("k must not be negative")
    width = _width(codes, None, d_bytes)
    words = C.to_words(codes, width) if width else codes
    rows = _sizes(words, words)
    if rows[0] * rows[1] <= NESTED_PAIRS:
        return find_pairs_within(codes, k, d_bytes=d_bytes).groupBy("dist").agg(F.count("*").alias("pairs"))
    return block_counts(words, None, rows, width, k, Plan.from_bits(width, k) if is_supported_bit(k, width) else None)


def near(a: DataFrame, b: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """Rows of a that have a code of b within k: a semi join."""
    return a.join(find_pairs_within(a, k, b, d_bytes=d_bytes).select(F.col("i").alias("id")).distinct(), "id", "left_semi")


def not_near(a: DataFrame, b: DataFrame, k: int, d_bytes: int | None = None) -> DataFrame:
    """Rows of a without a code of b within k: an anti join, as for a batch against a list of known codes."""
    return a.join(find_pairs_within(a, k, b, d_bytes=d_bytes).select(F.col("i").alias("id")).distinct(), "id", "left_anti")


#: Further names of the same self-join; how it is run is the optimizer's matter.
VARIANTS = {
    "st": find_pairs_self_bit,
    "par": find_pairs_self_bit,
    "par_prefetch": find_pairs_self_bit,
    "no_dedup": find_pairs_self_bit,
    "no_dedup_par": find_pairs_self_bit,
    "no_dedup_par_prefetch": find_pairs_self_bit,
    "no_dedup_par_prefetch_full": find_pairs_self_bit,
    "radix": find_pairs_self_bit,
}
