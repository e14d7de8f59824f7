"""Special functions and test statistics as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 7, to about 1e-12."""
    z = x + F.lit(7.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for i in range(1, 7):
        product = product * (x + float(i))
    return series - F.log(product)


#: Terms summed one by one; wider sums are integrated over ``NODES`` intervals.
MOST_TERMS, NODES = 4000, 1024
#: -log10 of what stands for a probability of zero.
NO_CHANCE = -math.log10(2.2250738585072014e-308)


def _log_gamma(x):
    """ln Gamma of an array of x >= 1, by the series of ``lgamma``."""
    import numpy as np

    z, product = x + 7.0, x
    for i in range(1, 7):
        product = product * (x + i)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def hypergeom_tail(k: int, total: int, marked: int, drawn: int) -> float:
    """-log10 P[X >= k] for ``drawn`` of ``total`` with ``marked`` marked; never negative.

    The largest term comes from log-gammas; the others follow from it by ratios
    below one, upwards and downwards, so that nothing over- or underflows.  The sums end
    where terms no longer count: twelve standard deviations out, or where the
    first ratio has shrunk them by forty orders of e.  Wider sums - of millions of
    bins - are Simpson integrals over that range with Euler-Maclaurin ends, so a
    test costs a bounded number of operations, whatever the counts.
    """
    import numpy as np

    lowest, most = max(drawn + marked - total, 0), min(marked, drawn)
    least = max(k, lowest)
    if least > most:
        return NO_CHANCE
    mode = min(most, max(least, (drawn + 1) * (marked + 1) // (total + 2)))
    rise = lambda j: (marked - j) * (drawn - j) / ((j + 1.0) * (total - marked - drawn + j + 1.0))
    fall = lambda j: j * (total - marked - drawn + j) / ((marked - j + 1.0) * (drawn - j + 1.0))
    share = marked / max(total, 1)
    spread = math.sqrt(drawn * share * (1 - share) * (total - drawn) / max(total - 1, 1))
    ratio = rise(float(mode))
    wide = min(12 * spread, 40 / -math.log(ratio)) if 0 < ratio < 1 else 12 * spread
    up, down = min(most - mode, int(wide) + 60), min(mode - least, int(12 * spread) + 60)

    def logs(x):
        parts = [(marked, x), (total - marked, drawn - x)]
        return sum(_log_gamma(n + 1.0) - _log_gamma(j + 1.0) - _log_gamma(n - j + 1.0) for n, j in parts)

    peak = float(logs(np.array([mode], dtype=float))[0])
    if up + down <= MOST_TERMS:
        above = np.cumprod(rise(np.arange(mode, mode + up, dtype=float))).sum()
        summed = 1.0 + above + np.cumprod(fall(np.arange(mode, mode - down, -1, dtype=float))).sum()
    else:
        first, last = float(mode - down), float(mode + up)
        x = np.linspace(first, last, NODES + 1)
        f = np.exp(logs(x) - peak)
        summed = (f[0] + f[-1] + 4 * f[1::2].sum() + 2 * f[2:-1:2].sum()) * (last - first) / NODES / 3 + (f[0] + f[-1]) / 2
        if first > lowest and last < most:  # slopes at the ends
            before, after = np.exp(logs(np.array([first - 1, last - 1])) - peak), np.exp(logs(np.array([first + 1, last + 1])) - peak)
            summed += ((after - before)[1] - (after - before)[0]) / 24
    whole = float(_log_gamma(np.array([total + 1.0]))[0] - _log_gamma(np.array([drawn + 1.0]))[0] - _log_gamma(np.array([total - drawn + 1.0]))[0])
    return max(0.0, -(peak - whole + math.log(summed)) / math.log(10))


def neg_log10_hypergeom_tail(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """``hypergeom_tail`` of each row (in Arrow batches; the number of operations a row is bounded)."""
    @F.pandas_udf("double")
    def tails(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
        return pd.Series([hypergeom_tail(*map(int, row)) for row in zip(k, total, marked, drawn)], dtype=float)

    return tails(k.cast("long"), total.cast("long"), marked.cast("long"), drawn.cast("long"))


def log_no_reference(total: Column, reference: Column, size: Column) -> Column:
    """P[no reference bin among ``size`` of ``total`` of which ``reference`` are reference]."""
    rest = total - reference
    d = lambda c: c.cast("double")
    p = F.exp(lgamma(d(rest) + 1.0) - lgamma(d(rest - size) + 1.0) + lgamma(d(total - size) + 1.0) - lgamma(d(total) + 1.0))
    return F.when(size > rest, F.lit(0.0)).otherwise(p)


# --- tails for small driver-side tables --------------------------------------

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_tail(t: float, d: float) -> float:
    """Two-sided."""
    return incomplete_beta(d / 2, 0.5, d / (d + t * t))


def t_quantile(q: float, d: float) -> float:
    """The value that Student's t exceeds with probability 1 - q (q of 0.5 or more), by bisection."""
    low, high = 0.0, 1.0
    while t_tail(high, d) / 2 > 1 - q:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, d) / 2 > 1 - q else (low, middle)
    return (low + high) / 2


def chi2_tail(x: float, d: float) -> float:
    """Upper incomplete gamma ratio, by series or continued fraction."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d_ = 1 / b
    h = d_
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d_ = 1 / (an * d_ + b)
        c = b + an / c
        h *= d_ * c
        if abs(d_ * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))
