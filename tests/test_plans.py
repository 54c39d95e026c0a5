import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitmesh.plans import chunks as P


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(0, 40))
def test_ranges_cover_all_and_differ_by_one_at_most(total, parts):
    found = P.chunk_boundaries(total, parts)
    assert found == P.chunk_bit_boundaries(total, parts)
    sizes = [b - a for a, b in found]
    assert len(found) == min(total, parts) and sum(sizes) == (total if parts else 0)
    assert all(x[1] == y[0] for x, y in zip(found, found[1:])) and max(sizes, default=0) - min(sizes, default=0) <= 1


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 130), st.integers(0, 70))
def test_bit_chunks_are_enough_and_short(d_bytes, k):
    found = P.bit_chunks_for(8 * d_bytes, k)
    assert all(0 < b - a <= P.MAX_KEY_BITS for a, b in found)
    if k:
        assert len(found) > k or 8 * d_bytes <= k
        assert sum(b - a for a, b in found) == 8 * d_bytes
    else:
        assert found[0][0] == 0


def test_regimes():
    assert P.is_supported(7, 8) and not P.is_supported(8, 8)
    assert P.is_supported_bit(63, 8) and not P.is_supported_bit(64, 8)
    with pytest.raises(P.UnsupportedRegime) as e:
        P.check(8, 8, False)
    assert (e.value.k, e.value.d_bytes) == (8, 8)
    for k, d in ((-1, 8), (0, 0), (64, 8)):
        with pytest.raises(ValueError):
            P.check(k, d, True)


def test_entropies():
    sample = np.array([[0b10000000], [0b00000000]], np.uint8)
    assert P.bit_entropies(sample).tolist() == [1.0] + [0.0] * 7
    assert P.bit_entropies(np.zeros((0, 2), np.uint8)).tolist() == [0.0] * 16


def test_adaptive_chunks_balance_and_leave_constant_bits_out():
    h = [0.0, 1.0, 0.5, 1.0, 0.5, 0.0]
    assert P.plan_adaptive_chunks(h, 2) == [[1, 2], [3, 4]]
    assert P.plan_adaptive_chunks([1.0] * 4, 2, max_bits=1) == [[0], [1]]
    assert P.Plan.adaptive(8, 3, np.zeros(64)) == P.Plan.from_bits(8, 3)


def test_masks_are_right_aligned_in_short_words():
    plan = P.Plan(9, (tuple(range(64, 72)),))
    assert plan.masks() == [{1: 255}]


def test_memory_estimate_grows():
    assert P.estimate_memory_mb(10**6, 32, 2, ["pairs byte"]) > P.estimate_memory_mb(10**5, 32, 2, ["pairs byte"]) > 200
