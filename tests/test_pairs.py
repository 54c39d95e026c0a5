import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitmesh.functions import codes as C
from bitmesh.operators import approx, pairs
from bitmesh.sources import generate
from bitmesh.sources.codes_io import from_numpy, to_tuples


def brute(a, b=None, k=0):
    other = a if b is None else b
    d = np.unpackbits(a[:, None, :] ^ other[None, :, :], axis=2).sum(axis=2)
    return sorted((i, j, int(d[i, j])) for i, j in zip(*np.nonzero(d <= k)) if b is not None or i < j)


def planted(n, d_bytes, k, seed=0):
    """Random codes with pairs at every distance from 0 to k + 1."""
    a = generate.xorshift_bytes(n, d_bytes, 0xA11CE + seed)
    a = a.copy()
    rng = np.random.default_rng(seed)
    for dist in range(min(k + 2, n // 2)):
        code = a[2 * dist].copy()
        for p in rng.choice(8 * d_bytes, dist, replace=False):
            code[p // 8] ^= 128 >> (p % 8)
        a[2 * dist + 1] = code
    return a


@pytest.mark.parametrize("d_bytes,k", [(8, 0), (8, 2), (32, 2), (32, 16), (13, 3), (64, 2), (128, 2), (1, 0)])
def test_self_joins_equal_brute_force(spark, d_bytes, k):
    a = planted(80, d_bytes, k)
    codes, truth = from_numpy(spark, a), brute(a, k=k)
    assert truth
    joins = [pairs.find_pairs_self_bit, pairs.find_pairs_self_adaptive, pairs.find_pairs_brute, pairs.find_pairs_self_auto]
    for join in joins + [pairs.find_pairs_self] * (k < d_bytes):
        assert to_tuples(join(codes, k)) == truth, join.__name__


def test_radius_of_the_width_in_bytes_needs_bits(spark):
    a = planted(60, 8, 8)
    codes = from_numpy(spark, a)
    with pytest.raises(ValueError):
        pairs.find_pairs_self(codes, 8)
    assert isinstance(pairs.try_find_pairs_self(codes, 8)[1], ValueError)
    assert pairs.try_find_pairs_self(codes, 2)[1] is None
    assert to_tuples(pairs.find_pairs_self_bit(codes, 8)) == brute(a, k=8)
    assert to_tuples(pairs.find_pairs_self_adaptive(codes, 8)) == brute(a, k=8)
    for join in (pairs.find_pairs_self_bit, pairs.find_pairs_self_adaptive):
        with pytest.raises(ValueError):
            join(codes, 64)
    assert len(to_tuples(pairs.find_pairs_within(codes, 64))) == 60 * 59 // 2


@pytest.mark.parametrize("q,k,d_bytes", [(12, 3, 8), (8, 3, 13), (16, 8, 8)])
def test_qgrams(spark, q, k, d_bytes):
    a = planted(40, d_bytes, k)
    assert to_tuples(pairs.find_pairs_qgram_self(from_numpy(spark, a), k, q)) == brute(a, k=k)


def test_qgram_length(spark):
    codes = from_numpy(spark, planted(10, 8, 1))
    for q in (0, 17):
        with pytest.raises(ValueError):
            pairs.find_pairs_qgram_self(codes, 1, q)


@pytest.mark.parametrize("d_bytes,k", [(8, 0), (8, 5), (32, 2), (8, 8)])
def test_cross_joins(spark, d_bytes, k):
    a, b = planted(30, d_bytes, k), planted(40, d_bytes, k, 1)
    b[:5] = a[:5]
    b[5] = a[6] ^ np.uint8(1 if k else 0)
    x, y, truth = from_numpy(spark, a), from_numpy(spark, b), brute(a, b, k)
    for join in [pairs.find_pairs_cross_bit, pairs.find_pairs_cross_brute] + [pairs.find_pairs_cross] * (k < d_bytes):
        assert to_tuples(join(x, y, k)) == truth
    assert to_tuples(pairs.find_pairs_within(x, k, y)) == truth
    near = sorted({i for i, _, _ in truth})
    assert [r["id"] for r in pairs.near(x, y, k).orderBy("id").collect()] == near
    assert [r["id"] for r in pairs.not_near(x, y, k).orderBy("id").collect()] == sorted(set(range(30)) - set(near))


def test_literal_codes(spark):
    i = np.arange(32)
    a = np.stack([i * 17, i * 31 + 7, i * 17, i * 53 + 99]).astype(np.uint8)
    assert to_tuples(pairs.find_pairs_self(from_numpy(spark, a), 2)) == [(0, 2, 0)]
    b = np.stack([i * 17, i * 17, i * 0]).astype(np.uint8)
    b[1, 5] ^= 1
    assert to_tuples(pairs.find_pairs_self(from_numpy(spark, b), 2)) == [(0, 1, 1)]


def test_edges(spark):
    none = from_numpy(spark, np.zeros((0, 4), np.uint8))
    one = from_numpy(spark, np.zeros((1, 4), np.uint8))
    same = from_numpy(spark, np.zeros((12, 4), np.uint8))
    for join in (pairs.find_pairs_self, pairs.find_pairs_self_bit, pairs.find_pairs_self_adaptive, pairs.find_pairs_brute):
        assert to_tuples(join(none, 1)) == [] and to_tuples(join(one, 1)) == []
        assert to_tuples(join(same, 1)) == [(i, j, 0) for i, j in itertools.combinations(range(12), 2)]
    assert to_tuples(pairs.find_pairs_cross(one, none, 1)) == []


def test_bad_codes(spark):
    text = spark.createDataFrame([(0, "x")], "id bigint, code string")
    with pytest.raises(TypeError):
        pairs.find_pairs_self(text, 0)
    for rows in ([(0, b"ab"), (1, b"abc")], [(0, b"ab"), (1, None)]):
        with pytest.raises(ValueError):
            pairs.find_pairs_self(spark.createDataFrame(rows, "id bigint, code binary"), 0)
    with pytest.raises(ValueError):
        pairs.find_pairs_cross(from_numpy(spark, np.zeros((1, 2), np.uint8)), from_numpy(spark, np.zeros((1, 3), np.uint8)), 0)
    with pytest.raises(ValueError):
        pairs.find_pairs_within(from_numpy(spark, np.zeros((1, 2), np.uint8)), -1)
    for bad, error in ((np.zeros((2, 2), np.int32), TypeError), (np.zeros(4, np.uint8), ValueError), (np.zeros((2, 0), np.uint8), ValueError)):
        with pytest.raises(error):
            from_numpy(spark, bad)


def test_no_distances(spark):
    assert pairs.find_pairs_within(from_numpy(spark, planted(10, 8, 1)), 1, return_distances=False).columns == ["i", "j"]


def test_bit_functions(spark):
    a = generate.xorshift_bytes(20, 13, 5)
    bits = np.unpackbits(a, axis=1)
    df = C.to_words(from_numpy(spark, a), 13)
    words = [F.col(c) for c in C.word_names(13)]
    rows = df.select("id", C.unpack_bits(words, 13).alias("u"), C.from_words(words, 13).alias("c"), *[C.gram_at(words, p, 12, 13).alias(f"g{p}") for p in (0, 50, 60, 92)]).orderBy("id").collect()
    for r, code, own in zip(rows, a, bits, strict=True):
        assert r["u"] == own.tolist() and bytes(r["c"]) == code.tobytes()
        for p in (0, 50, 60, 92):
            assert r[f"g{p}"] == int("".join(map(str, own[p : p + 12])), 2)
    assert C.extract_bits(words, 5, 5, 13) == []
    with pytest.raises(ValueError):
        C.extract_bits(words, 0, 129, 13)


def test_distance_of_bytes():
    assert C.hamming_distance(b"\xff\x00", b"\x00\x01") == 9 and C.hamming_distance(b"", b"") == 0
    with pytest.raises(ValueError):
        C.hamming_distance(b"a", b"ab")


def test_distance_kernels(spark):
    a = np.array([[0x00] * 32, [0xFF] * 32, [0xAA] * 32, [0x55] * 32], np.uint8)
    df = C.to_words(from_numpy(spark, a), 32)
    x, y = df.alias("x"), df.alias("y")
    u, v = ([F.col(f"{t}.{c}") for c in C.word_names(32)] for t in "xy")
    rows = {(r[0], r[1]): r[2:] for r in x.crossJoin(y).select("x.id", "y.id", C.hamming(u, v), C.hamming_le(u, v, 128), C.hamming_le(u, v, 256)).collect()}
    assert rows[0, 0] == (0, 0, 0) and rows[0, 1] == (256, None, 256) and rows[2, 3] == (256, None, 256) and rows[0, 2] == (128, 128, 128)


def test_golden_pair_counts(spark):
    """Published pair counts on the seeded clustered codes."""
    codes = from_numpy(spark, generate.clustered(100_000, 32)).repartition(4).cache()
    assert pairs.find_pairs_self_bit(codes, 4).count() == 162_111
    codes.unpersist()


def test_adaptive_ignores_constant_half(spark):
    a = generate.low_entropy(300, 32)
    plan = pairs.adaptive_plan(from_numpy(spark, a), 32, 2)
    assert all(p < 128 for chunk in plan.chunks for p in chunk)
    assert plan.candidates(a) < 0.01


def test_approximate_methods_find_a_subset(spark):
    a = planted(120, 8, 6)
    codes, truth = from_numpy(spark, a), set(brute(a, k=6))
    assert set(to_tuples(approx.multi_index_pairs(codes, 6))) == truth
    for found in (approx.lsh_pairs(codes, 6, 5, 8), approx.multi_probe_pairs(codes, 6, 16, 1), approx.nearest_pairs(codes, 6, 3)):
        got = to_tuples(found)
        assert set(got) <= truth and len(got) == len(set(got))
    r = approx.recall(approx.multi_probe_pairs(codes, 6, 8, 6), pairs.find_pairs_self_bit(codes, 6)).first()
    assert r["recall"] == 1.0 and r["truth"] == len(truth)
    assert approx.recall(pairs.find_pairs_self(codes.limit(1), 0), pairs.find_pairs_self(codes.limit(1), 0)).first()["recall"] is None


def test_nearest(spark):
    a = planted(60, 8, 6)
    codes = from_numpy(spark, a)
    d = np.unpackbits(a[:, None] ^ a[None], axis=2).sum(axis=2)
    got = {}
    for r in approx.nearest(codes.where("id < 5"), codes, 4).collect():
        got.setdefault(r["query_id"], []).append((r["dist"], r["id"]))
    for q, hits in got.items():
        assert sorted(hits) == sorted((int(d[q, j]), j) for j in range(60))[:4]


def test_known_width_reads_nothing_and_checks_in_the_plan(spark):
    a = planted(40, 8, 3)
    codes = from_numpy(spark, a)
    for join in (pairs.find_pairs_self, pairs.find_pairs_self_bit, pairs.find_pairs_self_adaptive, pairs.find_pairs_self_auto, pairs.find_pairs_brute):
        assert to_tuples(join(codes, 3, 8)) == brute(a, k=3)
    assert to_tuples(pairs.find_pairs_cross_bit(codes, codes, 3, 8)) == brute(a, a, 3)
    for bad in ([(0, b"ab"), (1, b"abc")], [(0, b"ab"), (1, None)]):
        with pytest.raises(Exception, match="a code has not 2 bytes"):
            pairs.find_pairs_self(spark.createDataFrame(bad, "id bigint, code binary"), 0, 2).collect()


def test_gram_places_are_enough():
    for bits, k, q in ((64, 3, 10), (104, 3, 8), (64, 0, 5), (512, 9, 16)):
        places = pairs.gram_places(bits, k, q)
        assert len(places) == k * q + 1 and places[0] == 0 and max(places) <= bits - q


def test_nearest_by_growing_radius(spark):
    a = generate.clustered(300, 16, dup_fraction=0.6, noise_bits=1)
    codes = from_numpy(spark, a)
    d = np.unpackbits(a[:, None] ^ a[None], axis=2).sum(axis=2)
    got = {}
    for r in approx.nearest(codes.where("id < 40"), codes, 3).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["dist"], r["id"]))
    for q in range(40):
        assert [x[1:] for x in sorted(got[q])] == sorted((int(d[q, j]), j) for j in range(300))[:3]
