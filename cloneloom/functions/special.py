"""Tail probabilities in numpy, as pandas functions over columns: normal, t, F, chi-square, Kolmogorov-Smirnov."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LANCZOS = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


#: Series and fractions go on until a term changes nothing; they take some square roots of the degrees of freedom.
EPS, MOST = 1e-15, 200_000


def lgamma(x) -> np.ndarray:
    """ln Gamma(x), x > 0 (Lanczos with g = 7; fixed coefficients above)."""
    x = np.asarray(x, float) - 1
    total = np.full_like(x, 0.99999999999980993)
    for i, c in enumerate(_LANCZOS):
        total = total + c / (x + i + 1)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def _stirling(x) -> np.ndarray:
    """ln Gamma(x) - ((x - 0.5) ln x - x + ln(2 pi) / 2)."""
    x = np.asarray(x, float)
    big = np.maximum(x, 10.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * big * big)) / (big * big)) / (big * big)) / big
    return np.where(x >= 10, series, lgamma(x) - ((x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi)))


def _log1p_less(u) -> np.ndarray:
    """ln(1 + u) - u without loss near zero."""
    small = np.where(np.abs(u) < 0.01, u, 0.0)
    series = -small * small * (0.5 - small * (1 / 3 - small * (0.25 - small * (0.2 - small * (1 / 6 - small * (1 / 7 - small / 8))))))
    return np.where(np.abs(u) < 0.01, series, np.log1p(u) - u)


def _log_power(s, x) -> np.ndarray:
    """s ln x - x - ln Gamma(s), with the large parts cancelled on paper."""
    return s * _log1p_less((x - s) / s) + 0.5 * np.log(s / (2 * math.pi)) - _stirling(s)


def _log_front(p, q, y) -> np.ndarray:
    """p ln y + q ln(1 - y) - ln B(p, q), with the large parts cancelled on paper."""
    n = p + q
    u, v = (y * n - p) / p, ((1 - y) * n - q) / q  # p u + q v = 0
    return p * _log1p_less(u) + q * _log1p_less(v) + 0.5 * np.log(p * q / (2 * math.pi * n)) + _stirling(n) - _stirling(p) - _stirling(q)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_log_front(p, q, y)) / p
        front = np.where(y <= 0, 0.0, front)
        tiny = 1e-300
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, MOST):
            before = h.copy()
            for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if not (np.abs(h - before) > EPS * np.abs(h)).any():
                break
    return np.where(swap, 1 - front * h, front * h)


def gamma_upper(s, x) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(s, x)."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.maximum(np.asarray(x, float), 0))
    with np.errstate(all="ignore"):
        front = np.exp(_log_power(s, x))
        term = total = 1 / s
        near = np.where(x < s + 1, x, 0.0)  # the series is used there only
        for n in range(1, MOST):
            term = term * near / (s + n)
            total = total + term
            if not (term > EPS * total).any():
                break
        low = 1 - front * total
        far = np.where(x < s + 1, s + 2, x)  # and the fraction beyond
        b = far + 1 - s
        c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for n in range(1, MOST):
            before = h.copy()
            an, b = -n * (n - s), b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if not (np.abs(h - before) > EPS * np.abs(h)).any():
                break
    return np.where(x <= 0, 1.0, np.where(x < s + 1, low, front * h))


def normal_two_sided(z) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) if v == v else math.nan for v in np.asarray(z, float)])


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x, df) -> np.ndarray:
    return gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def ks_asymptotic(d, n, m) -> np.ndarray:
    """Kolmogorov's limit of the two-sample statistic."""
    d, n, m = (np.asarray(v, float) for v in (d, n, m))
    x = d * np.sqrt(n * m / (n + m))
    k = np.arange(1, 101)[:, None]
    tail = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x), axis=0)
    return np.where(x < 0.2, 1.0, np.clip(tail, 0, 1))


def _log_binomial(x, n, p) -> np.ndarray:
    """ln of the binomial probability of x, with the large parts cancelled on paper."""
    with np.errstate(all="ignore"):
        apart = lambda k, mean: -k * _log1p_less((mean - k) / k)
        inner = _stirling(n) - _stirling(x) - _stirling(n - x) - apart(x, n * p) - apart(n - x, n * (1 - p)) + 0.5 * np.log(n / (2 * math.pi * x * (n - x)))
        edge = np.where(n == 0, 0.0, np.where(x == 0, n * np.log1p(-p), n * np.log(p)))
    return np.where((x == 0) | (x == n), edge, inner)


def log_hypergeometric(k, r, c, n) -> np.ndarray:
    """ln of the probability that k of a draw of r are among the c marked ones of n; both c and n - c are above zero."""
    p = r / n
    return _log_binomial(k, c, p) + _log_binomial(r - k, n - c, p) - _log_binomial(r, n, p)


def _tail(k, r, c, n, step: int, width: int = 128) -> np.ndarray:
    """Sum of the probabilities from k on, up (step 1) or down (-1), until a term no longer counts."""
    end = np.where(step > 0, np.minimum(r, c), np.maximum(0, r + c - n))
    total = np.zeros(len(k))
    todo = np.flatnonzero((end - k) * step >= 0)
    term, k = np.exp(log_hypergeometric(k, r, c, n)), k.copy()
    while len(todo):
        at = k[todo, None] + step * np.arange(width)
        a, b, m = r[todo, None], c[todo, None], n[todo, None]
        ratio = (a - at) * (b - at) / ((at + 1) * (m - a - b + at + 1)) if step > 0 else at * (m - a - b + at) / ((a - at + 1) * (b - at + 1))
        ratio = np.where((end[todo, None] - at) * step > 0, ratio, 0.0)
        terms = term[todo, None] * np.cumprod(np.concatenate([np.ones((len(todo), 1)), ratio], axis=1), axis=1)
        total[todo] += terms[:, :-1].sum(axis=1)
        term[todo], k[todo] = terms[:, -1], k[todo] + step * width
        todo = todo[terms[:, -1] > EPS * 1e-3 * total[todo]]
    return total


def fisher_two_sided(a, b, c, d) -> np.ndarray:
    """Sum of the hypergeometric probabilities that are not above the table's own.

    Probabilities rise up to the mode and fall from there, so they are two tails: one from the table's own cell, one from
    the first cell beyond the mode that is no likelier, found by bisection.  Both are summed outwards by their ratios.
    """
    cells, back = np.unique(np.stack([np.asarray(x, float) for x in (a, b, c, d)], axis=1), axis=0, return_inverse=True)
    a, r, c, n = cells[:, 0], cells[:, 0] + cells[:, 1], cells[:, 0] + cells[:, 2], cells.sum(axis=1)
    out = np.ones(len(cells))
    low, high = np.maximum(0, r + c - n), np.minimum(r, c)
    open_ = np.flatnonzero(low < high)  # else there is one table only
    a, r, c, n, low, high = (x[open_] for x in (a, r, c, n, low, high))
    own = log_hypergeometric(a, r, c, n)
    mode = np.clip(np.floor((r + 1) * (c + 1) / (n + 2)), low, high)
    under = a < mode
    step = np.where(under, 1.0, -1.0)
    # near: no likelier cells are beyond it; far: the last cell that can be one.
    near, far = mode.copy(), np.where(under, high, low) + step
    while (np.abs(far - near) > 1).any():
        middle = np.floor((near + far) / 2)
        likelier = log_hypergeometric(middle, r, c, n) > own + 1e-7
        near, far = np.where(likelier, middle, near), np.where(likelier, far, middle)
    whole = log_hypergeometric(mode, r, c, n) <= own + 1e-7
    p = np.empty(len(a))
    for mask, s in ((under, 1), (~under, -1)):
        x = [v[mask] for v in (r, c, n)]
        p[mask] = _tail(a[mask], *x, -s) + _tail(far[mask], *x, s)
    out[open_] = np.where(whole, 1.0, np.minimum(p, 1.0))
    return out[back.ravel()]


def fisher_bounds(a, k1, k2, n) -> tuple[np.ndarray, np.ndarray]:
    """Cells up to the first bound, or from the second on, are no likelier than a; k1 and k2 are the margins, n the whole."""
    a, k1, k2, n = (np.asarray(x, float) for x in np.broadcast_arrays(a, k1, k2, n))
    low, high = np.maximum(0, k1 + k2 - n), np.minimum(k1, k2)
    mode = np.clip(np.floor((k1 + 1) * (k2 + 1) / (n + 2)), low, high)
    with np.errstate(all="ignore"):
        own = np.where(low < high, log_hypergeometric(a, k1, k2, n), 0.0) + 1e-7
        whole = (low == high) | (log_hypergeometric(mode, k1, k2, n) <= own)
        bounds = []
        for end in (low - 1, high + 1):
            near, far = mode, end  # likelier, and not
            while (np.abs(near - far) > 1).any():
                middle = np.floor((near + far) / 2)
                likelier = log_hypergeometric(middle, k1, k2, n) > own
                near, far = np.where(likelier, middle, near), np.where(likelier, far, middle)
            bounds.append(far)
    return np.where(whole, high, bounds[0]).astype(np.int64), np.where(whole, low, bounds[1]).astype(np.int64)


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    cells = pd.DataFrame({"a": a, "b": b, "c": c, "d": d})
    known = cells.notna().all(axis=1).to_numpy()
    out = np.full(len(cells), np.nan)
    out[known] = fisher_two_sided(*cells[known].to_numpy(float).T)
    return pd.Series(out).where(known, None)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f, d1, d2))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x, df))


@F.pandas_udf(T.DoubleType())
def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(ks_asymptotic(d, n, m))
