import numpy as np
import pytest

from segstate.operators import kernel as K
from tests.fixtures import A, B0, B1, ESTIMATES, P, PI0, PI1, SCORES, parse


def _args(pi, b):
    return np.array([pi]), np.array([A]), np.array([b]), np.array([P])


@pytest.mark.parametrize("s", list(SCORES))
def test_scores(s):
    obs = np.array([parse(s)])
    s1, s0, s1p = SCORES[s]
    assert K.score(obs, *_args(PI1, B1))[0] == pytest.approx(s1, abs=1e-8)
    assert K.score(obs, *_args(PI0, B0))[0] == pytest.approx(s0, abs=1e-8)
    assert K.score(obs[:, :2], *_args(PI1, B1))[0] == pytest.approx(s1p, abs=1e-8)


def test_single_symbol_by_hand():
    # ln(.6 * .2 * .5^2 + .4 * .2 * .1^2)
    assert K.score(np.array([[0]]), *_args(PI1, B1))[0] == pytest.approx(np.log(.0308), abs=1e-12)


def test_duration_one_column_gives_minus_infinity():
    obs = np.array([[0, 1]])
    pi, a, b, p = _args(PI1, B1)
    assert K.score(obs, pi, a, b, p[:, :, :1])[0] == -np.inf


@pytest.mark.parametrize("s", list(ESTIMATES))
def test_estimates(s):
    obs = np.array([parse(s)])
    pi, a, b, p = _args(PI1, B1)
    _, npi, na, nb, np_ = K.e_step(obs, 3, pi, a, b, p)
    epi, ea, eb, ep = ESTIMATES[s]
    np.testing.assert_allclose(npi[0], epi, atol=1e-8)
    np.testing.assert_allclose(na[0], ea, atol=1e-8)
    np.testing.assert_allclose(nb[0], eb, atol=1e-8)
    np.testing.assert_allclose(np_[0], ep, atol=1e-8)


def test_impossible_symbol_edge_row():
    obs = np.array([[0, 2, 0]])
    pi, a, _, p = _args(PI1, B1)
    b = np.array([[[.5, .5, 0], [.5, .5, 0]]])
    sc, npi, na, nb, np_ = K.e_step(obs, 3, pi, a, b, p)
    assert sc[0] == -np.inf
    assert np.isnan(na).all() and np.isnan(np_).all()
    np.testing.assert_allclose(npi[0], [.6, .4])
    np.testing.assert_allclose(nb[0], [[.5, 0, .5], [.5, 0, .5]])


def test_batch_equals_single():
    rng = np.random.default_rng(0)
    obs = rng.integers(0, 3, size=(7, 9))
    pi, a, b, p = (np.repeat(x, 7, axis=0) for x in _args(PI1, B1))
    batch = K.e_step(obs, 3, pi, a, b, p)
    for n in range(7):
        one = K.e_step(obs[n:n + 1], 3, pi[:1], a[:1], b[:1], p[:1])
        for x, y in zip(batch, one):
            np.testing.assert_allclose(x[n], y[0], atol=1e-12)
