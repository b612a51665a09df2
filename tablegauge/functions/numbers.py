"""Scalar rules shared by several operators, on numbers and on Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the quadratic limit on distinct nominal values.
NOMINAL_LINEAR = 0.00854480458
NOMINAL_QUADRATIC = 1.31494511e-8
NOMINAL_INTERCEPT = 14.017948334463796


def nominal_limit(n: int) -> float:
    """Most distinct values a string column of ``n`` rows may have to count as nominal."""
    if n <= 16:
        return math.ceil(n / 3)
    if n <= 100_000:
        fitted = NOMINAL_LINEAR * n + NOMINAL_QUADRATIC * n * n + NOMINAL_INTERCEPT
        return math.ceil(min(fitted, n / 4))
    return n / 100


def nominal_limit_column(n: Column) -> Column:
    """:func:`nominal_limit` as an expression."""
    n = n.cast("double")
    fitted = F.lit(NOMINAL_LINEAR) * n + F.lit(NOMINAL_QUADRATIC) * n * n + F.lit(NOMINAL_INTERCEPT)
    return (F.when(n <= 16, F.ceil(n / 3).cast("double"))
            .when(n <= 100_000, F.ceil(F.least(fitted, n / 4)).cast("double"))
            .otherwise(n / 100))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling series at x + 8, shifted back (error below 1e-11)."""
    shift = 8
    y = x + shift
    inv = F.lit(1.0) / y
    inv2 = inv * inv
    series = inv * (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * F.lit(1 / 1680))))
    stirling = (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series
    product = x
    for k in range(1, shift):
        product = product * (x + k)
    return stirling - F.ln(product)


def next_prime(n: int) -> int:
    """Smallest prime >= ``n``."""
    candidate = max(2, n)
    while any(candidate % d == 0 for d in range(2, math.isqrt(candidate) + 1)):
        candidate += 1
    return candidate


def hash_number(text: Column) -> Column:
    """60 bits of the md5 of ``text`` as BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
