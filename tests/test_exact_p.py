"""Exact small-sample p-values against enumeration and known values."""

import itertools
import math

import pytest

from tessera.functions.tails import mann_whitney_p, signed_rank_p
from tessera.operators import stats as H


def test_signed_rank_enumerated():
    for n in (1, 4, 7):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        top = n * (n + 1) // 2
        for w in range(top // 2 + 1):
            want = min(1.0, 2 * sum(x <= w for x in sums) / len(sums))
            assert signed_rank_p(n, w) == pytest.approx(want)


def test_rank_sum_enumerated():
    for n0, n1 in ((1, 3), (3, 4), (4, 4), (5, 2)):
        us = [sum(c) - n0 * (n0 - 1) // 2 for c in itertools.combinations(range(n0 + n1), n0)]
        for u in range(n0 * n1 + 1):
            top = max(u, n0 * n1 - u)
            assert mann_whitney_p(n0, n1, u) == pytest.approx(min(1.0, 2 * sum(x >= top for x in us) / len(us)))


def _diffs(spark, values):
    return spark.createDataFrame([(f"d{i}", 1, "A", "B", float(v)) for i, v in enumerate(values)],
                                 "dataset string, c int, label_a string, label_b string, d double")


def test_known_wilcoxon_values(spark):
    assert H.wilcoxon(_diffs(spark, [1, 2, 3, 4, 5])).first().p_value == pytest.approx(0.0625)
    tied = H.wilcoxon(_diffs(spark, [1, 1, 3, 4, 5, -2])).first()  # ties: normal form
    assert tied.p_value == pytest.approx(math.erfc(abs(tied.z) / math.sqrt(2)))
    zero = H.wilcoxon(_diffs(spark, [0, 1, 2, 3, 4, 5]), zero_method="wilcox").first()  # a zero: normal form
    assert zero.n == 5 and zero.p_value == pytest.approx(0.0431, abs=1e-4)


def test_known_mann_whitney_values(spark):
    df = lambda rows: spark.createDataFrame([(1, s, float(v)) for s, v in rows], "c int, side int, d double")
    sides = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (1, 6), (1, 7), (1, 8)]
    assert H.mann_whitney(df(sides)).first().p_value == pytest.approx(0.0285714, abs=1e-6)
    tied = [(0, 1), (0, 2), (0, 3), (1, 3), (1, 4), (1, 5)]
    got = H.mann_whitney(df(tied)).first()  # u = 0.5: z = (8.5 - 4.5 - 0.5) / sd
    sd = math.sqrt(9 / 12 * (7 - 6 / 30))
    assert got.p_value == pytest.approx(math.erfc(3.5 / sd / math.sqrt(2)))
