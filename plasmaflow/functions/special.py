"""Distribution functions on numpy arrays: the tails that Spark has no column function for."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

TINY = 1e-300
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x) -> np.ndarray:
    """Log-gamma by distinct argument: counts repeat, so few are evaluated."""
    x = np.asarray(x, float)
    distinct, back = np.unique(x, return_inverse=True)
    return _lgamma(np.maximum(distinct, TINY)).astype(float)[back].reshape(x.shape)


def gamma_p(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x): power series left of a + 1, continued fraction right of it."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(x <= 0, 0.0, np.nan)
    scale = np.exp(-x + a * np.log(np.maximum(x, TINY)) - lgamma(a))
    left, right = (x > 0) & (x < a + 1), (x > 0) & (x >= a + 1)
    if left.any():
        p, y = a[left], x[left]
        term = total = 1 / p
        k = p.copy()
        while (np.abs(term) > np.abs(total) * 1e-16).any():
            k = k + 1
            term = term * y / k
            total = total + term
        out[left] = total * scale[left]
    if right.any():
        p, y = a[right], x[right]
        b = y + 1 - p
        c, d = np.full_like(y, 1 / TINY), 1 / b
        h = d
        for i in range(1, 20_000):
            an = -i * (i - p)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < TINY, TINY, an * d + b)
            c = np.where(np.abs(b + an / c) < TINY, TINY, b + an / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[right] = 1 - h * scale[right]
    return np.clip(out, 0, 1)


def poisson_cdf(k, lam) -> np.ndarray:
    k = np.floor(np.asarray(k, float))
    return np.where(k < 0, 0.0, 1 - gamma_p(np.maximum(k, 0) + 1, lam))


def poisson_sf(k, lam) -> np.ndarray:
    """P(X > k)."""
    k = np.floor(np.asarray(k, float))
    return np.where(k < 0, 1.0, gamma_p(np.maximum(k, 0) + 1, lam))


def poisson_two_sided(k, lam) -> np.ndarray:
    """min(1, 2 min(P(X <= k), P(X >= k))); 1 where lam is not positive."""
    k, lam = np.broadcast_arrays(np.asarray(k, float), np.asarray(lam, float))
    p = 2 * np.minimum(poisson_cdf(k, np.maximum(lam, TINY)), poisson_sf(k - 1, np.maximum(lam, TINY)))
    return np.where(lam <= 0, 1.0, np.minimum(p, 1.0))


def poisson_tail(k, lam, alternative: str) -> np.ndarray:
    k, lam = np.broadcast_arrays(np.asarray(k, float), np.asarray(lam, float))
    high, low = poisson_sf(k - 1, np.maximum(lam, TINY)), poisson_cdf(k, np.maximum(lam, TINY))
    if alternative == "greater":
        return high
    return low if alternative == "less" else np.minimum(1.0, 2 * np.where(k <= lam, low, high))


def beta_i(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction on the side that converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, y, 0.5)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d
    for m in range(1, 2000):
        for an in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + an * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + an / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            step = c * d
            h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    part = np.clip(front * h, 0, 1)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(flip, 1 - part, part)))


def beta_ppf(q, a, b) -> np.ndarray:
    """Quantile of Beta(a, b) by bisection."""
    q, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (q, a, b)))
    low, high = np.zeros_like(q), np.ones_like(q)
    for _ in range(70):
        mid = (low + high) / 2
        under = beta_i(a, b, mid) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def binom_sf(k, n, p) -> np.ndarray:
    """P(X >= k)."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, p)))
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, beta_i(np.maximum(k, 1), np.maximum(n - k + 1, TINY), p)))


def _log_binom(k, n, p) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * np.log(p) + (n - k) * np.log1p(-p)


def binom_two_sided(k, n, p) -> np.ndarray:
    """Exact test: the probability of all counts that are no likelier than k."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, p)))
    out = np.ones(k.shape)
    for i in np.ndindex(k.shape):
        if n[i] == 0:
            continue
        if p[i] <= 0 or p[i] >= 1:
            out[i] = float(k[i] == (0 if p[i] <= 0 else n[i]))
            continue
        mass = _log_binom(np.arange(n[i] + 1), n[i], p[i])
        out[i] = min(1.0, float(np.exp(mass[mass <= mass[int(k[i])] + 1e-7]).sum()))
    return out


def binom_tail(k, n, p, alternative: str) -> np.ndarray:
    if alternative == "two-sided":
        return binom_two_sided(k, n, p)
    return binom_sf(k, n, p) if alternative == "greater" else 1 - binom_sf(np.asarray(k) + 1, n, p)


def clopper_pearson(k, n, alternative: str = "two-sided", mass: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact bounds of k / n: both for the two-sided alternative, the lower for "greater" (the upper is 1), the upper for "less" (the lower is 0)."""
    k, n = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n)))
    tail = (1 - mass) / 2 if alternative == "two-sided" else 1 - mass
    low, high = np.zeros(k.shape), np.ones(k.shape)
    some, short = (k > 0) & (alternative != "less"), (k < n) & (alternative != "greater")
    low[some] = beta_ppf(tail, k[some], n[some] - k[some] + 1)
    high[short] = beta_ppf(1 - tail, k[short] + 1, n[short] - k[short])
    return low, high


def odds_ratio(a, b, c, d) -> np.ndarray:
    """a d / (b c): nan where a row or column is empty, else infinite where b c is 0."""
    a, b, c, d = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, c, d)))
    empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(empty, np.nan, np.where(b * c == 0, np.inf, a * d / np.where(b * c == 0, 1, b * c)))


def beta_binomial_sf(k, n, a, b) -> np.ndarray:
    """P(X >= k) for a beta-binomial, summed over the shorter tail."""
    k, n, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, a, b)))
    out = np.empty(k.shape)
    for i in np.ndindex(k.shape):
        upper = k[i] > n[i] / 2
        x = np.arange(k[i], n[i] + 1) if upper else np.arange(0, k[i])
        mass = lgamma(n[i] + 1) - lgamma(x + 1) - lgamma(n[i] - x + 1) + lgamma(x + a[i]) + lgamma(n[i] - x + b[i]) - lgamma(n[i] + a[i] + b[i]) + lgamma(a[i] + b[i]) - lgamma(a[i]) - lgamma(b[i])
        total = float(np.exp(mass).sum())
        out[i] = total if upper else 1 - total
    return np.clip(out, 0, 1)


def fisher_two_sided(a, b, c, d) -> np.ndarray:
    """Fisher's exact p of the table ((a, b), (c, d))."""
    a, b, c, d = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, c, d)))
    out = np.ones(a.shape)
    for i in np.ndindex(a.shape):
        row, col, total = a[i] + b[i], a[i] + c[i], a[i] + b[i] + c[i] + d[i]
        x = np.arange(max(0.0, row + col - total), min(row, col) + 1)
        if len(x) < 2:
            continue
        mass = lgamma(row + 1) + lgamma(total - row + 1) + lgamma(col + 1) + lgamma(total - col + 1) - lgamma(total + 1) - lgamma(x + 1) - lgamma(row - x + 1) - lgamma(col - x + 1) - lgamma(total - row - col + x + 1)
        own = mass[int(a[i] - x[0])]
        out[i] = min(1.0, float(np.exp(mass[mass <= own + 1e-7]).sum()))
    return out


def norm_isf(p) -> np.ndarray:
    """Upper normal quantile, p clipped to [1e-300, 1 - 1e-16]."""
    quantile = NormalDist().inv_cdf
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    return np.array([-quantile(v) for v in p.reshape(-1)]).reshape(p.shape)


def t_quantile(p, df) -> np.ndarray:
    """Quantile of Student's t for p >= 0.5, by the incomplete beta function."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    x = np.maximum(beta_ppf(2 * (1 - p), df / 2, np.full(df.shape, 0.5)), TINY)
    return np.sqrt(df * (1 - x) / x)


def norm_sf(z) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.asarray(z, float).reshape(-1)]).reshape(np.shape(z))


def chi2_sf(x, df) -> np.ndarray:
    return 1 - gamma_p(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def kolmogorov_sf(d, n) -> np.ndarray:
    """Asymptotic p of a Kolmogorov-Smirnov distance d on n values."""
    t = np.asarray(d, float) * np.sqrt(np.asarray(n, float))
    j = np.arange(1, 101)[:, None]
    return np.clip(2 * ((-1.0) ** (j - 1) * np.exp(-2 * j**2 * np.atleast_1d(t) ** 2)).sum(axis=0), 0, 1)


def poisson_power(null, alt, alpha: float = 0.05) -> np.ndarray:
    """Chance that a count with mean `alt` exceeds the (1 - alpha) quantile of one with mean `null`: normal above a mean of 5, exact below."""
    null, alt = np.asarray(null, float), np.asarray(alt, float)
    z = float(norm_isf(np.array([alpha]))[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        normal = norm_sf(-(alt - null - z * np.sqrt(null)) / np.sqrt(alt))
    out, few = np.array(normal, float), np.flatnonzero(null <= 5)
    if len(few):
        k = np.arange(64.0)
        reached = np.array([poisson_cdf(k, np.full(len(k), m)) for m in null[few]]) >= 1 - alpha
        out[few] = 1 - poisson_cdf(reached.argmax(axis=1).astype(float), alt[few])
    return np.clip(out, 0, 1)
