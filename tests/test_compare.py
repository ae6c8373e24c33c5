import itertools
import math

import numpy as np

from lexmill.functions import arrays
from lexmill.operators import compare


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (6, 6)):
        for _ in range(20):
            c = rng.random((n, m)).round(1)
            got = compare.assign(c)
            small = c if n <= m else c.T
            want = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
            assert math.isclose(sum(c[i, j] for i, j in enumerate(got) if j >= 0), want)


def test_match_and_stability():
    a = np.eye(4) + 0.01
    assert [(i, j) for i, j, _ in compare.match_topics(a, a[[2, 0, 3, 1]])] == [(0, 1), (1, 3), (2, 0), (3, 2)]
    assert compare.stability([a, a[::-1]])["mean"] > 0.999


def test_chains():
    rng = np.random.default_rng(0)
    iid = rng.standard_normal((4, 1000))
    assert 3000 < compare.ess(iid) < 5500 and abs(compare.rhat(iid) - 1) < 0.01 and abs(compare.geweke(iid[0])) < 3
    walk = iid.cumsum(axis=1)
    assert compare.ess(walk) < 100 and compare.rhat(walk) > 1.1


def test_special_functions():
    assert np.allclose(arrays.digamma(np.array([0.5, 1.0, 10.0])), [-1.9635100260214235, -0.5772156649015329, 2.251752589066721])
    assert np.allclose(arrays.trigamma(np.array([1.0, 5.5])), [math.pi**2 / 6, 0.19924282], atol=1e-4)
    assert math.isclose(arrays.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-6) and math.isclose(arrays.chi2_tail(30, 10), 0.000856641, rel_tol=1e-4)
    assert math.isclose(arrays.normal_p(1.959963984540054), 0.05, rel_tol=1e-9)
