"""Decimal arithmetic that rounds exactly once.

Spark keeps only a few fractional digits when it divides wide decimals, so casting a quotient to two
places would round twice (a true 4.2849999 becomes 4.285000, then 4.29). The helpers below divide
without a fraction and decide the last digit from the remainder.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"
RATE = "decimal(10,2)"
SCORE = "decimal(10,2)"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded_ratio(num: Column | str, den: Column | str, places: int = 2) -> Column:
    """``num / den`` to ``places`` digits, halves away from zero; NULL for a zero or NULL divisor.

    Inputs are counts or amounts with at most two fractional digits.
    """
    num, den = _column(num), _column(den)
    n = F.abs(num).cast(MONEY) * F.lit(Decimal(10**places))
    d = F.nullif(F.abs(den).cast(MONEY), F.lit(Decimal("0.00")))
    rest = n % d
    whole = ((n - rest) / d).cast("decimal(38,0)")
    digits = whole + F.when(rest * 2 >= d, 1).otherwise(0)
    # A product keeps all its places only if its digits fit into 38.
    unsigned = digits.cast(f"decimal({38 if places <= 6 else 37 - places},0)") * F.lit(Decimal(1).scaleb(-places))
    return F.when((num < 0) != (den < 0), -unsigned).otherwise(unsigned).cast(f"decimal(38,{places})")


def percent(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole`` to two places."""
    return rounded_ratio(_column(part).cast("decimal(36,2)") * F.lit(Decimal(100)), whole).cast(RATE)


def mean_score(total: str, n: str) -> Column:
    """Average of whole numbers to two places, from bigint ``total`` and ``n``, all in long arithmetic."""
    magnitude = F.expr(f"(200 * abs({total}) + {n}) div nullif(2 * {n}, 0)").cast("decimal(12,0)")
    unsigned = magnitude * F.lit(Decimal("0.01"))
    return F.when(F.col(total) < 0, -unsigned).otherwise(unsigned).cast(SCORE)
