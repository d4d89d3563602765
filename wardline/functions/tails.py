"""Tail probabilities for one row of statistics per group.

The inputs are a handful of aggregated numbers, so these small helpers run as
vectorised functions on the already reduced result.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1_000_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    raise ArithmeticError("the incomplete beta function did not converge")


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_tail(s: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - s
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 1_000_000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * value
    raise ArithmeticError("the incomplete gamma function did not converge")


def student_two_sided(t: float, df: float) -> float:
    return 0.0 if math.isinf(t) else beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def f_upper(value: float, df1: float, df2: float) -> float:
    return 0.0 if math.isinf(value) else beta_cdf(df2 / (df2 + df1 * value), df2 / 2.0, df1 / 2.0)


def chi_square_upper(value: float, df: float) -> float:
    return 1.0 if df <= 0 else gamma_tail(df / 2.0, value / 2.0)


def fisher_two_sided(a: float, b: float, c: float, d: float) -> float:
    """Sum of the hypergeometric probabilities not above the observed one.

    Both tails are summed outward only as far as terms matter, so large counts
    need about as many terms as the spread of the distribution.
    """
    row, column, total = int(a + b), int(a + c), int(a + b + c + d)
    low, high, seen = max(0, row + column - total), min(row, column), int(a)

    def log_p(k: int) -> float:
        return sum(
            math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
            for n, r in ((column, k), (total - column, row - k))
        ) - (math.lgamma(total + 1) - math.lgamma(row + 1) - math.lgamma(total - row + 1))

    bound = log_p(seen) + 1e-7
    mode = min(max((row + 1) * (column + 1) // (total + 2), low), high)

    def outward(start: int, step: int) -> float:
        k, summed = start, 0.0
        while low <= k <= high:
            term = math.exp(log_p(k))
            summed += term
            if term < summed * 1e-17:
                break
            k += step
        return summed

    def boundary(inner: int, outer: int, step: int) -> int:
        """First value from the mode outward whose probability is not above the observed one."""
        if log_p(outer) > bound:
            return outer + step
        near, far = 0, abs(outer - inner)
        while near < far:
            middle = (near + far) // 2
            if log_p(inner + step * middle) <= bound:
                far = middle
            else:
                near = middle + 1
        return inner + step * near

    left, right = boundary(mode, low, -1), boundary(mode, high, 1)
    if left >= right:
        return 1.0
    return min(1.0, outward(left, -1) + outward(right, 1))


_PERIOD = 840  # least common multiple of the part sizes 1 to 8


@lru_cache(maxsize=16)
def _cumulated_parts(small: int) -> tuple[int, ...]:
    """Coefficients of ((1 - q**840) / (1 - q)) * product of (1 - q**840) / (1 - q**i), i up to ``small``."""
    row = [1]
    for part in (1, *range(1, small + 1)):
        row += [0] * _PERIOD
        for k in range(len(row) - 1, _PERIOD - 1, -1):
            row[k] -= row[k - _PERIOD]
        for k in range(part, len(row)):
            row[k] += row[k - part]
        while len(row) > 1 and not row[-1]:
            row.pop()
    return tuple(row)


def _sums_up_to(limit: int, small: int) -> int:
    """Ways to choose at most ``small`` unordered positive parts with a sum within ``limit``."""
    row = _cumulated_parts(small)
    return sum(row[k] * math.comb((limit - k) // _PERIOD + small, small) for k in range(limit % _PERIOD, min(limit + 1, len(row)), _PERIOD))


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of a tie-free U statistic, for at most 8 values in one sample and any number in the other.

    Arrangements with a U within a limit are partitions that fit in a box of
    small x large.  Those that fit follow from those of any size by
    inclusion and exclusion over the ``small`` factors 1 - q**(large + i), so the
    cost depends on the small sample alone and the counts are whole numbers.
    """
    small, large = sorted((int(n1), int(n2)))
    if small > 8:
        raise ValueError("exact counts need at most 8 values in one sample")
    low = int(min(u, small * large - u))
    shifts = {0: 1}
    for i in range(1, small + 1):
        for shift, sign in list(shifts.items()):
            moved = shift + large + i
            if moved <= low:
                shifts[moved] = shifts.get(moved, 0) - sign
    ways = sum(sign * _sums_up_to(low - shift, small) for shift, sign in shifts.items() if sign)
    return min(1.0, float(Fraction(2 * ways, math.comb(small + large, small))))


def _column_function(helper, arity: int):
    def over(*series: pd.Series) -> pd.Series:
        return pd.Series([
            None if any(pd.isna(v) for v in row) else float(helper(*row)) for row in zip(*series)
        ], dtype="float64")

    if arity == 2:
        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return over(a, b)
    elif arity == 3:
        def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return over(a, b, c)
    else:
        def call(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return over(a, b, c, d)
    return F.pandas_udf(call, "double")


def _normal_two_sided(z: float, _unused: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_p(t, df):
    return _column_function(student_two_sided, 2)(t, df)


def chi_square_p(value, df):
    return _column_function(chi_square_upper, 2)(value, df)


def f_p(value, df1, df2):
    return _column_function(f_upper, 3)(value, df1, df2)


def normal_p(z):
    return _column_function(_normal_two_sided, 2)(z, F.lit(0.0))


def fisher_p(a, b, c, d):
    return _column_function(fisher_two_sided, 4)(a, b, c, d)


def mann_whitney_exact_p(u, n1, n2):
    return _column_function(mann_whitney_exact, 3)(u, n1, n2)
