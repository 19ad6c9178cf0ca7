"""Gaussian hidden Markov models with diagonal covariances, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    loglik: float = -np.inf

    def emission(self, x: np.ndarray) -> np.ndarray:
        """Log density of each row under each state."""
        d = x[:, None, :] - self.mean[None]
        return -0.5 * ((d * d / self.var[None]).sum(2) + np.log(2 * np.pi * self.var).sum(1)[None])

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states; ties to the smaller state."""
        e, move = self.emission(x), np.log(self.move + 1e-300)
        best, back = np.log(self.start + 1e-300) + e[0], np.zeros(e.shape, int)
        for t in range(1, len(x)):
            z = best[:, None] + move
            back[t] = z.argmax(0)
            best = z.max(0) + e[t]
        path = np.zeros(len(x), int)
        path[-1] = best.argmax()
        for t in range(len(x) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def bic(self, n: int) -> float:
        k, d = self.mean.shape
        return -2 * self.loglik + (k * (k - 1) + (k - 1) + 2 * k * d) * np.log(n)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Labels; centres are spread out at first, and an empty cluster takes the farthest row."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
    for _ in range(rounds):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        label = d.argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else x[d.min(1).argmax()] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def fit_hmm(x: np.ndarray, k: int, seed: int, rounds: int = 100, tol: float = 1e-2) -> Hmm:
    """Expectation maximisation with scaled forward and backward passes."""
    rng = np.random.default_rng(seed)
    label = kmeans(x, k, rng)
    floor = 1e-3 * np.maximum(x.var(0), 1e-8)
    m = Hmm(np.full(k, 1 / k), np.full((k, k), 1 / k), np.array([x[label == j].mean(0) if (label == j).any() else x[rng.integers(len(x))] for j in range(k)]), np.tile(x.var(0) + floor, (k, 1)))
    before = -np.inf
    for _ in range(rounds):
        log_e = m.emission(x)
        top = log_e.max(1, keepdims=True)
        e = np.exp(log_e - top)
        n = len(x)
        a, scale = np.zeros((n, k)), np.zeros(n)
        a[0] = m.start * e[0]
        for t in range(n):
            if t:
                a[t] = (a[t - 1] @ m.move) * e[t]
            scale[t] = max(a[t].sum(), 1e-300)
            a[t] /= scale[t]
        b = np.ones((n, k))
        for t in range(n - 2, -1, -1):
            b[t] = (m.move @ (e[t + 1] * b[t + 1])) / scale[t + 1]
        g = a * b
        g /= g.sum(1, keepdims=True)
        joint = (a[:-1, :, None] * m.move[None] * (e[1:] * b[1:])[:, None, :] / scale[1:, None, None]).sum(0)
        m.loglik = float(np.log(scale).sum() + top.sum())
        m.start = g[0] / g[0].sum()
        m.move = (joint + 1e-12) / (joint + 1e-12).sum(1, keepdims=True)
        w = np.maximum(g.sum(0), 1e-12)
        m.mean = (g.T @ x) / w[:, None]
        m.var = np.maximum((g.T @ (x * x)) / w[:, None] - m.mean**2, 0) + floor
        if m.loglik - before < tol:
            break
        before = m.loglik
    return m
