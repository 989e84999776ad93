"""Vectorised per-sequence HSMM recursions (numpy, batch axis first).

Used inside Spark tasks (``mapInArrow``) by the E-step: every call handles a
batch of N sequences of one length T; the only Python loops run over t and d.
All arrays are row-major: pi (N,M), a (N,M,M), b (N,M,K), p (N,M,D).
IEEE double semantics throughout (0/0 = NaN, ln 0 = -Inf), like the model
"""

from __future__ import annotations

import numpy as np


def l1(v: np.ndarray, axis: int = -1) -> np.ndarray:
    """F5 along ``axis``: divide by the sum of absolute values, keep zeros."""
    n = np.abs(v).sum(axis=axis, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n == 0, v, v / n)


def emissions(obs: np.ndarray, b: np.ndarray) -> np.ndarray:
    """e (N,T,M), the columns of b (N,M,K) that the symbols pick."""
    return np.take_along_axis(b, obs[:, None, :], axis=2).transpose(0, 2, 1)


def segments(e: np.ndarray, d_cols: int) -> np.ndarray:
    """U (N,T,M,D) with u[..,0] = e and u[:,t,:,d] = u[:,t,:,d-1] *
    e[:,t-d+1] where t-d+1 >= 0, else 0."""
    t_len = e.shape[1]
    u = np.zeros((*e.shape, d_cols))
    u[..., 0] = e
    for d in range(1, d_cols):
        if d - 1 < t_len:
            u[:, d - 1:, :, d] = u[:, d - 1:, :, d - 1] * e[:, : t_len - d + 1, :]
    return u


def segment_likelihood(obs: np.ndarray, b: np.ndarray, d_cols: int):
    """R1 from the symbols: emissions and segment likelihoods."""
    e = emissions(obs, b)
    return e, segments(e, d_cols)


def forward(pi, a, p, u, heads=None):
    """Alpha (N,T,M), alpha' (N,T+1,M), scale (N,T), score (N,).

    ``heads`` (N,H+1,M) goes on inside a sequence: u then starts H positions
    before the block, where alpha' is known up to position H, and the results
    of the first H positions are left empty (scale 1)."""
    n, t_len, m, d_cols = u.shape
    off = ~np.eye(m, dtype=bool)
    ap = np.zeros((n, t_len + 1, m))
    known = 0 if heads is None else heads.shape[1] - 1
    ap[:, :known + 1] = l1(pi)[:, None] if heads is None else heads
    alpha = np.zeros((n, t_len, m))
    scale = np.ones((n, t_len))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for t in range(known, t_len):
            acc = np.zeros((n, m))
            for d in range(d_cols):
                s = t - d + 1
                if s >= 0:
                    acc = acc + ap[:, s] * p[:, :, d] * u[:, t, :, d]
            rs = acc.sum(axis=1)
            scale[:, t] = rs
            alpha[:, t] = np.where(rs[:, None] == 0, acc, acc * (1.0 / rs)[:, None])
            moved = np.where(off[None], alpha[:, t, :, None] * a, 0.0).sum(axis=1)
            ap[:, t + 1] = l1(moved)
        score = np.log(scale).sum(axis=1)
    return alpha, ap, scale, score


def backward_block(a, p, u, tails=None):
    """R4 inside a sequence: beta (N,T,M), beta' (N,T+1,M) of a block whose u
    reaches H positions beyond it, where ``tails`` (N,H,M) are the betas.
    Without ``tails`` the block ends the sequence. beta'[:, 0] holds what the
    block gives for the position before it, and so does the third result, the
    beta there."""
    n, t_ext, m, d_cols = u.shape
    off = ~np.eye(m, dtype=bool)
    t_len = t_ext - (0 if tails is None else tails.shape[1])
    beta = np.zeros((n, t_ext + 1, m))  # the last place is read as position -1
    bp = np.zeros((n, t_len + 1, m))
    start = t_len - 1
    if tails is None:
        beta[:, t_len - 1] = 1.0
        with np.errstate(invalid="ignore", over="ignore"):
            bp[:, t_len] = l1(p[:, :, 0] * u[:, t_len - 1, :, 0] * beta[:, t_len - 1])
        start = t_len - 2
    else:
        beta[:, t_len:t_ext] = tails
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for t in range(start, -2, -1):
            acc = np.zeros((n, m))
            for d in range(d_cols):
                if t + d < t_ext and t + d >= 0:
                    acc = acc + p[:, :, d] * u[:, t + d, :, d] * beta[:, t + d]
            bp[:, t + 1] = l1(acc)
            back = np.where(off[None], a * bp[:, t + 1][:, None, :], 0.0).sum(axis=2)
            beta[:, t] = l1(beta[:, t] + back)
    return beta[:, :t_len], bp, beta[:, -1]


def backward_end(a, p, u, beta, e_last):
    """The sweep at t = -1, where index -1 wraps to the end (Q3): beta' at 0 and
    the beta that replaces the last one; ``e_last`` are the last emissions and
    ``u``, ``beta`` the first positions."""
    n, t_len, m, d_cols = u.shape
    off = ~np.eye(m, dtype=bool)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        acc = np.zeros((n, m)) + p[:, :, 0] * e_last * 1.0
        for d in range(1, d_cols):
            if d - 1 < t_len:
                acc = acc + p[:, :, d] * u[:, d - 1, :, d] * beta[:, d - 1]
        first = l1(acc)
        return first, l1(1.0 + np.where(off[None], a * first[:, None, :], 0.0).sum(axis=2))


def backward(a, p, u):
    """Beta (N,T,M) and beta' (N,T+1,M). The sweep runs t = T-1 .. -1;
    at t = -1 the index -1 wraps to T-1 (Q3), exactly like numpy indexing."""
    n, t_len, m, d_cols = u.shape
    off = ~np.eye(m, dtype=bool)
    beta = np.zeros((n, t_len, m))
    bp = np.zeros((n, t_len + 1, m))
    beta[:, t_len - 1] = 1.0
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        bp[:, t_len] = l1(p[:, :, 0] * u[:, t_len - 1, :, 0] * beta[:, t_len - 1])
        for t in range(t_len - 2, -2, -1):
            acc = np.zeros((n, m))
            for d in range(d_cols):
                if t + d < t_len:
                    acc = acc + p[:, :, d] * u[:, t + d, :, d] * beta[:, t + d]
            bp[:, t + 1] = l1(acc)
            back = np.where(off[None], a * bp[:, t + 1][:, None, :], 0.0).sum(axis=2)
            beta[:, t] = l1(beta[:, t] + back)
    return beta, bp


def duration_posterior(ap, p, u, beta):
    """N (N,T,M,D), L1-normalised over d for each (t, i)."""
    n, t_len, m, d_cols = u.shape
    post = np.zeros((n, t_len, m, d_cols))
    with np.errstate(invalid="ignore", over="ignore"):
        for d in range(d_cols):
            t0 = max(0, d - 1)
            if t0 >= t_len:
                continue
            post[:, t0:, :, d] = (ap[:, t0 - d + 1: t_len - d + 1] * p[:, None, :, d]
                                  * u[:, t0:, :, d] * beta[:, t0:])
    return l1(post, axis=3)


def transition_posterior(alpha, a, bp):
    """Xi (N,T,M,M) = alpha(i,t) A(i,j) beta'(j,t+1), rows L1-normalised."""
    with np.errstate(invalid="ignore", over="ignore"):
        xi = alpha[:, :, :, None] * a[:, None, :, :] * bp[:, 1:, None, :]
    return l1(xi, axis=3)


def occupancy(pi, alpha, ap, beta, bp):
    """Gamma (N,T,M); may be negative (Q7)."""
    n, t_len, m = alpha.shape
    g = np.zeros((n, t_len, m))
    with np.errstate(invalid="ignore", over="ignore"):
        g[:, 0] = l1(pi * bp[:, 0])
        for t in range(1, t_len - 1):
            g[:, t] = l1(g[:, t - 1] + ap[:, t] * bp[:, t] - alpha[:, t - 1] * beta[:, t - 1])
    g[:, t_len - 1] = l1(alpha[:, t_len - 1])
    return g


def _ratio(num, den):
    with np.errstate(invalid="ignore", divide="ignore"):
        return num / den


def symbol_sums(obs, g, k):
    """Sums of the occupancy g (N,T,M) by symbol: (N,M,K)."""
    n, _, m = g.shape
    flat = (np.arange(n)[:, None] * k + obs).ravel()
    return np.stack([np.bincount(flat, weights=g[:, :, i].ravel(), minlength=n * k).reshape(n, k)
                     for i in range(m)], axis=1)


def new_transition(num_a):
    return l1(_ratio(num_a, num_a.sum(axis=2, keepdims=True)), axis=2)


def new_emission(num_b, sum_g):
    return l1(_ratio(num_b, sum_g[:, :, None]), axis=2)


def new_emission_cells(num_b, sum_g, at):
    """``new_emission`` of cells (C,M), the symbols of sequence ``at`` (C,)."""
    found = _ratio(num_b, sum_g[at])
    n = np.stack([np.bincount(at, weights=np.abs(v), minlength=len(sum_g)) for v in found.T], axis=1)[at]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n == 0, found, found / n)


def new_duration(num_p):
    new_p = _ratio(num_p, num_p.sum(axis=2, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return new_p * (1.0 / new_p.sum(axis=(1, 2)))[:, None, None]


def new_initial(g0):
    return l1(_ratio(g0, g0.sum(axis=1, keepdims=True)))


def estimates(obs, k, pi, a, p, u, alpha, ap, beta, bp):
    """R5-R8 for one batch: new pi (N,M), a (N,M,M), b (N,M,K), p (N,M,D)."""
    num_a = transition_posterior(alpha, a, bp).sum(axis=1)
    num_p = duration_posterior(ap, p, u, beta).sum(axis=1)
    g = occupancy(pi, alpha, ap, beta, bp)
    return (new_initial(g[:, 0]), new_transition(num_a),
            new_emission(symbol_sums(obs, g, k), g.sum(axis=1)), new_duration(num_p))


def e_step(obs, k, pi, a, b, p):
    """R9 for N sequences of one length: (score, new_pi, new_a, new_b, new_p)."""
    _, u = segment_likelihood(obs, b, p.shape[2])
    alpha, ap, _, score = forward(pi, a, p, u)
    beta, bp = backward(a, p, u)
    return (score, *estimates(obs, k, pi, a, p, u, alpha, ap, beta, bp))


def score(obs, pi, a, b, p):
    """R3 only."""
    _, u = segment_likelihood(obs, b, p.shape[2])
    return forward(pi, a, p, u)[3]
