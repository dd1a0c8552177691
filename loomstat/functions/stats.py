"""Statistics on small arrays and tables that neither Spark nor its companions have."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of the largest size, the first of equal ones, is positive."""
    at = np.abs(np.round(vectors, 12)).argmax(axis=0)
    signs = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs)


def normality(n: int, skewness: float, kurtosis: float) -> tuple[float, float]:
    """D'Agostino's K squared and its p-value, from the biased skewness and the biased kurtosis (3 for a normal law); n of 8 at least."""
    y = skewness * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - mean) / math.sqrt(var)
    m = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / m * (2 / m + math.sqrt(1 + 4 / m**2))
    ratio = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_tail(value: float, df1: float, df2: float) -> float:
    """P(F > value)."""
    return 1.0 if value <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * value))


def levene(groups: list[tuple[int, float, float]]) -> tuple[float, float]:
    """W and p from each group's n, mean and sum of squares of |x - its median|."""
    n, k = sum(g[0] for g in groups), len(groups)
    grand = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - grand) ** 2 for g in groups)
    within = sum(g[2] - g[0] * g[1] ** 2 for g in groups)
    w = (n - k) / (k - 1) * between / within if within else math.inf
    return w, f_tail(w, k - 1, n - k)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def adjusted_rand(table: np.ndarray) -> float:
    """From a contingency table."""
    pairs = lambda x: (x * (x - 1) / 2).sum()
    table = np.asarray(table, float)
    both, a, b = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    total = table.sum() * (table.sum() - 1) / 2
    expected = a * b / total if total else 0.0
    return 1.0 if (a + b) / 2 == expected else (both - expected) / ((a + b) / 2 - expected)


def normalised_information(table: np.ndarray) -> float:
    """Mutual information by the arithmetic mean of entropies."""
    p = np.asarray(table, float) / np.sum(table)
    a, b = p.sum(1), p.sum(0)
    entropy = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
    mean = (entropy(a) + entropy(b)) / 2
    if mean == 0:
        return 1.0
    on = p > 0
    return float((p[on] * np.log(p[on] / np.outer(a, b)[on])).sum() / mean)


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of the largest total gain, exactly, by subsets of columns; up to some 16 of them."""
    gain = np.asarray(gain, float)
    if gain.shape[0] > gain.shape[1]:
        return sorted((r, c) for c, r in assignment(gain.T))
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in gain:
        now: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for c, g in enumerate(row):
                if not used >> c & 1 and (used | 1 << c not in now or total + g > now[used | 1 << c][0]):
                    now[used | 1 << c] = (total + g, (*chosen, c))
        best = now
    return list(enumerate(max(best.values())[1]))


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b, centred and turned onto the centred a."""
    a, b = a - a.mean(0), b - b.mean(0)
    u, _, vt = np.linalg.svd(b.T @ a)
    return b @ u @ vt


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees between the spaces of the columns, ascending."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    u, s, vt = np.linalg.svd(qa.T @ qb)
    k = min(qa.shape[1], qb.shape[1])
    rest = np.linalg.svd(qb @ vt.T[:, :k] - qa @ (qa.T @ (qb @ vt.T[:, :k])), compute_uv=False)
    sines, cosines = np.clip(np.sort(rest), 0, 1), np.clip(np.sort(s[:k])[::-1], -1, 1)
    return np.degrees(np.where(cosines**2 > 0.5, np.arcsin(sines), np.arccos(cosines)))


def ranks(x: np.ndarray) -> np.ndarray:
    """Mean ranks from 1."""
    order = np.argsort(x, kind="stable")
    values = x[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    last = np.append(first[1:], len(x))
    out = np.empty(len(x))
    out[order] = np.repeat((first + last + 1) / 2, last - first)
    return out


def correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    if len(a) < 3 or a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])
