"""The test of normality for one array, straight from its definition."""

import math

import numpy as np


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """By bisection on erf: a few dozen exact halvings are enough for any sample."""
    low, high = np.full(len(p), -9.0), np.full(len(p), 9.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in mid]) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2



def shapiro_wilk(values: np.ndarray) -> tuple[float | None, float | None]:
    """Royston's approximation (AS R94, n from 3 to 5000): W and p; none for fewer values or no spread."""
    x = np.sort(values[np.isfinite(values)])
    n = len(x)
    if n < 3 or x[-1] - x[0] < 1e-19:
        return None, None
    m = _normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    ssq, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(ssq)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # Royston's polynomials for the outer weights.
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
        if n <= 5:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = last, -last
        else:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-1], a[0], a[-2], a[1] = last, -last, second, -second
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    # Royston's mean and deviation of the transformed W.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))
