"""Special functions and small-sample distributions, on the driver, for inputs bounded by prototypes or classes."""

from __future__ import annotations

import math

import numpy as np


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers: shifted up to 12 or more, then Stirling's series."""
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    while (small := x < 12).any():
        shift[small] += np.log(x[small])
        x[small] += 1
    i = 1 / x
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def expected_mutual_information(rows: np.ndarray, columns: np.ndarray) -> float:
    """Expectation of the mutual information of two labelings with these class sizes, over random matchings.

    Sums the hypergeometric law of every cell; where its range is wide, only within 50 standard
    deviations of the mean, beyond which nothing is left in double precision.
    """
    n = int(rows.sum())
    if n == 0:
        return 0.0
    lg = lambda v: log_gamma(np.asarray(v, np.float64) + 1)
    total = 0.0
    for a in rows.tolist():
        for b in columns.tolist():
            low, high = max(1, a + b - n), min(a, b)
            mean = a * b / n
            spread = 50 * math.sqrt(max(mean * (n - a) * (n - b) / max(n * (n - 1), 1), 1.0)) + 50
            low, high = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
            for start in range(low, high + 1, 1 << 20):
                k = np.arange(start, min(high, start + (1 << 20) - 1) + 1, dtype=np.float64)
                chance = lg(a) + lg(b) + lg(n - a) + lg(n - b) - lg(n) - lg(k) - lg(a - k) - lg(b - k) - lg(n - a - b + k)
                total += float((k / n * (np.log(n * k) - math.log(a) - math.log(b)) * np.exp(chance)).sum())
    return total


def student_two_sided(t: float, degrees: float) -> float:
    """P(|T| >= |t|)."""
    if degrees <= 0:
        return 1.0
    if math.isinf(t):
        return 0.0
    return incomplete_beta(degrees / 2, 0.5, degrees / (degrees + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * f)


def mann_whitney_two_sided(u: float, n1: int, n0: int, tie_sum: float) -> float:
    """Two-sided p of U; exact where a group has at most 8 and there are no ties, else normal with tie and continuity corrections.

    ``tie_sum`` is the sum of t^3 - t over tied groups.
    """
    n = n1 + n0
    if n1 == 0 or n0 == 0:
        return 1.0
    top = max(u, n1 * n0 - u)
    if min(n1, n0) <= 8 and tie_sum == 0:
        ways = _rank_sum_ways(n1, n0)
        return min(1.0, 2 * float(ways[math.ceil(top) :].sum() / ways.sum()))
    spread = math.sqrt(n1 * n0 / 12 * (n + 1 - tie_sum / (n * (n - 1))))
    if spread == 0:
        return 1.0
    return min(1.0, math.erfc((top - n1 * n0 / 2 - 0.5) / spread / math.sqrt(2)))


def _rank_sum_ways(n1: int, n0: int) -> np.ndarray:
    """How many orders of the two groups give each U: Gaussian binomial coefficients, as ratios of products."""
    ways = np.zeros(n1 * n0 + 1)
    ways[0] = 1.0
    k = min(n1, n0)
    for i in range(1, k + 1):
        up, down = max(n1, n0) + i, i
        grown = ways.copy()
        grown[up:] -= ways[: len(ways) - up] if up < len(ways) else 0
        for at in range(down, len(grown)):
            grown[at] += grown[at - down]
        ways = grown
    return ways
