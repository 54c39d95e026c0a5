"""Codes as binary columns or 64-bit words, encoders for them, and bit expressions on words.

A code of d bytes becomes ceil(d / 8) BIGINT words, big-endian: bit p of the
code (most significant bit of the first byte first) is bit ``63 - p % 64`` of
word ``p // 64``, or counted from the word's own width if the last is short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def n_words(d_bytes: int) -> int:
    return math.ceil(d_bytes / 8)


def word_names(d_bytes: int) -> list[str]:
    return [f"w{i}" for i in range(n_words(d_bytes))]


def code_width(codes: DataFrame, code: str = "code") -> int:
    """The common width of all codes in bytes. ValueError for null codes and for codes of different widths; 0 for an empty table."""
    row = codes.agg(F.min(F.octet_length(code)), F.max(F.octet_length(code)), F.count_if(F.col(code).isNull())).first()
    if row[2]:
        raise ValueError(f"{row[2]} codes are null")
    if row[0] != row[1]:
        raise ValueError(f"codes have different widths: {row[0]} to {row[1]} bytes")
    return row[0] or 0


def require_binary(codes: DataFrame, code: str = "code") -> None:
    kind = dict(codes.dtypes).get(code)
    if kind != "binary":
        raise TypeError(f"column {code} must be binary, it is {kind}")


def to_words(codes: DataFrame, d_bytes: int, id: str = "id", code: str = "code") -> DataFrame:
    """``id, w0, w1, ...`` of binary codes. A null code or one of another width stops the query."""
    words = [F.conv(F.hex(F.substring(code, 8 * i + 1, 8)), 16, -10).cast("bigint") for i in range(n_words(d_bytes))]
    fits = F.coalesce(F.octet_length(code) == d_bytes, F.lit(False))
    words[0] = F.when(fits, words[0]).otherwise(F.raise_error(F.lit(f"a code has not {d_bytes} bytes")).cast("bigint"))
    return codes.select(F.col(id).cast("bigint").alias("id"), *[w.alias(n) for w, n in zip(words, word_names(d_bytes), strict=True)])


def from_words(words: list[Column], d_bytes: int) -> Column:
    """The binary code of a row's words."""
    parts = [F.lpad(F.hex(w), 16, "0") for w in words]
    if d_bytes % 8:
        parts[-1] = F.substring(parts[-1], 17 - 2 * (d_bytes % 8), 16)
    return F.unhex(F.concat(*parts))


def word_values(code: bytes) -> list[int]:
    """The words of a code outside of Spark, with the sign that a BIGINT has."""
    return [int.from_bytes(code[i : i + 8], "big", signed=i + 8 <= len(code)) for i in range(0, len(code), 8)]


def hamming_distance(a: bytes, b: bytes) -> int:
    """Number of differing bits of two codes of one width, outside of Spark."""
    if len(a) != len(b):
        raise ValueError(f"codes have different widths: {len(a)} and {len(b)} bytes")
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Number of differing bits of two codes, given as words."""
    out = None
    for x, y in zip(a, b, strict=True):
        bits = F.bit_count(x.bitwiseXOR(y))
        out = bits if out is None else out + bits
    return out


def hamming_le(a: list[Column], b: list[Column], k: int) -> Column:
    """The distance if it is at most k, else null. Later words are left out where the first ones already differ in more bits."""
    first = hamming(a[:1], b[:1])
    whole = hamming(a, b)
    if len(a) > 1:
        return F.when(first > k, None).when(whole <= k, whole)
    return F.when(whole <= k, whole)


def register(spark: SparkSession) -> None:
    """SQL function ``hamming(a, b)`` on single words."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)")


def bit_at(words: list[Column], p: int, d_bytes: int) -> Column:
    width = min(64, 8 * d_bytes - 64 * (p // 64))
    return F.shiftrightunsigned(words[p // 64], width - 1 - p % 64).bitwiseAND(F.lit(1).cast("bigint")).cast("int")


def extract_bits(words: list[Column], lo: int, hi: int, d_bytes: int) -> list[Column]:
    """Key of the bit range [lo, hi), of at most 128 bits, as one BIGINT for each word that it touches. Two keys are equal if the bits are."""
    if hi < lo or hi - lo > 128:
        raise ValueError(f"a key takes 0 to 128 bits, not {hi - lo}")
    return extract_bits_at(words, range(lo, hi), d_bytes)


def extract_bits_at(words: list[Column], positions, d_bytes: int) -> list[Column]:
    """Key of any bit positions, as one masked BIGINT for each word that they touch."""
    masks: dict[int, int] = {}
    for p in positions:
        width = min(64, 8 * d_bytes - 64 * (p // 64))
        masks[p // 64] = masks.get(p // 64, 0) | 1 << (width - 1 - p % 64)
    return [masked(words[w], m) for w, m in sorted(masks.items())]


def signed(number: int) -> int:
    """64 bits as a BIGINT."""
    return number - (1 << 64) if number >= 1 << 63 else number


def masked(word: Column, mask: int) -> Column:
    return word if mask == (1 << 64) - 1 else word.bitwiseAND(F.lit(signed(mask)).cast("bigint"))


def unpack_bits(words: list[Column], d_bytes: int) -> Column:
    """array<int> of the code's bits, most significant first."""
    return F.array(*[bit_at(words, p, d_bytes) for p in range(8 * d_bytes)])


def gram_at(words: list[Column], p: int, q: int, d_bytes: int) -> Column:
    """The q-bit number (q of at most 16) that starts at bit p."""
    at, word = p % 64, p // 64
    width = min(64, 8 * d_bytes - 64 * word)
    low = F.lit((1 << q) - 1).cast("bigint")
    if at + q <= width:
        return F.shiftrightunsigned(words[word], width - at - q).bitwiseAND(low)
    more = at + q - width
    after = min(64, 8 * d_bytes - 64 * (word + 1))
    return F.shiftleft(words[word], more).bitwiseOR(F.shiftrightunsigned(words[word + 1], after - more)).bitwiseAND(low)


def sign_code(embedding: str = "embedding", dims: int = 64) -> Column:
    """Sign bits of an embedding as a binary code: 1 where a component is positive."""
    if dims % 8:
        raise ValueError("the number of dimensions must be a multiple of 8")
    bits = F.array_join(F.transform(embedding, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.unhex(F.concat(*[F.lpad(F.conv(F.substring(bits, 32 * i + 1, min(32, dims - 32 * i)), 2, 16), min(32, dims - 32 * i) // 4, "0") for i in range(math.ceil(dims / 32))]))


def md5_code(text: str = "text") -> Column:
    """128-bit digest as a binary code."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def hex_code(text: str) -> Column:
    return F.unhex(text)


LANE, LANES = 21, 3


def simhash(rows: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``id, code``: 64-bit SimHash over the distinct lower-case words, split at white space. A bit is 1 if more words have it than not.

    The counts of three bits share a number, each in a lane of 21 bits, which
    makes 22 sums instead of 64; a text may have two million distinct words.
    """
    words = rows.select(F.col(id).cast("bigint").alias("id"), F.explode(F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+"))).alias("word"))
    hashed = words.select("id", F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 16), 16, -10).cast("bigint").alias("h"))

    def lanes(g: int) -> Column:
        three = F.shiftrightunsigned("h", LANES * g).bitwiseAND(F.lit(7).cast("bigint"))
        return sum((F.shiftleft(three.bitwiseAND(F.lit(1 << j).cast("bigint")), (LANE - 1) * j) for j in range(1, LANES)), three.bitwiseAND(F.lit(1).cast("bigint")))

    groups = math.ceil(64 / LANES)
    sums = hashed.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(lanes(g)).alias(f"s{g}") for g in range(groups)])
    lane = F.lit((1 << LANE) - 1).cast("bigint")
    bits = [F.when(2 * F.shiftrightunsigned(f"s{b // LANES}", LANE * (b % LANES)).bitwiseAND(lane) > F.col("n"), "1").otherwise("0") for b in range(63, -1, -1)]
    code = F.unhex(F.concat(*[F.lpad(F.conv(F.concat(*bits[32 * i : 32 * i + 32]), 2, 16), 8, "0") for i in range(2)]))
    return sums.select("id", code.alias("code"))
