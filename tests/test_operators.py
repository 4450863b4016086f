import numpy as np
import pytest

from quern.operators import align, batching


@pytest.mark.parametrize("ref,hyp,want", [("ab", "b", (2, 1, 0, 1, 0)), ("aab", "ab", (3, 2, 0, 1, 0)), ("ab", "ba", (2, 1, 0, 1, 1)), ("", "x", (0, 0, 0, 0, 1)), ("ab", "ab", (2, 2, 0, 0, 0)), ("", "", (0, 0, 0, 0, 0))])
def test_counts(ref, hyp, want):
    assert align.counts(list(ref), list(hyp)) == want


def test_count_sums():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (list(rng.integers(0, 4, rng.integers(0, 9)).astype(str)) for _ in range(2))
        n, c, s, d, i = align.counts(a, b)
        assert (c + s + d, c + s + i, s + d + i) == (len(a), len(b), align.distance(a, b)) and n == len(a)


def test_fold():
    assert batching.fold([3, 4, 9, 2, 2], 12) == [0, 0, 1, 2, 2]
    assert batching.fold([500, 1], 12) == [0, 1]


def test_forced_align():
    p = np.log(np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]))
    assert align.forced_align(p, [1, 2]).tolist() == [0, 1, 1, 2]


def test_registered_queries(spark):
    from quern.plans import catalogue

    for name in sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
