"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MISSING_CATEGORY = "__MISSING__"
WILSON_Z_95 = 1.959963984540054


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session zone."""
    since = f"({ts} - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(f"CAST(CAST(CAST({since} AS INTERVAL SECOND) AS DECIMAL(20,6)) * 1000000 AS BIGINT)")


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL instead of an error when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def category(value: Column) -> Column:
    """Categories as strings; NULL and the empty string become one explicit category."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(MISSING_CATEGORY))


def hour_of_day(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 3600), F.lit(24))


def day_of_week(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 86400), F.lit(7))


def percentage(value: Column) -> Column:
    return F.coalesce(F.concat(fixed_decimals(value * 100, 2, None), F.lit("%")), F.lit("N/A"))


def grouped_count(value: Column) -> Column:
    return F.coalesce(F.format_number(value.cast("double"), 0), F.lit("N/A"))


def fixed_decimals(value: Column, places: int = 3, missing: str | None = "N/A") -> Column:
    return F.coalesce(F.translate(F.format_number(value, places), ",", ""), F.lit(missing))


def log_odds(p: Column, epsilon: float = 1e-6) -> Column:
    bounded = clipped(p, epsilon, 1.0 - epsilon)
    return F.ln(bounded / (1.0 - bounded))


def wilson_bounds(successes: Column, total: Column, z: float = WILSON_Z_95) -> tuple[Column, Column]:
    """Score interval of a proportion, clipped to [0, 1]; NULL when there are no trials."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes / n
    middle = (p + F.lit(z * z) / (2 * n)) / (1 + F.lit(z * z) / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / (1 + F.lit(z * z) / n)
    lower = F.when(n.isNotNull(), F.greatest(F.lit(0.0), middle - half))
    upper = F.when(n.isNotNull(), F.least(F.lit(1.0), middle + half))
    return lower, upper


def two_proportion_z(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """Pooled z statistic; NULL when a group is empty or the standard error is 0."""
    a = F.nullif(n_a.cast("double"), F.lit(0.0))
    b = F.nullif(n_b.cast("double"), F.lit(0.0))
    pooled = (hits_a + hits_b) / (a + b)
    error = F.nullif(F.sqrt(pooled * (1 - pooled) * (1 / a + 1 / b)), F.lit(0.0))
    return (hits_a / a - hits_b / b) / error


def all_of(tests) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
