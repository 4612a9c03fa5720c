"""Column helpers with the rounding, defaulting and statistics rules that the queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, places: int = 0) -> Column:
    """Half up, towards plus infinity: floor(x * 10^n + 0.5) / 10^n, as a double."""
    k = float(10**places)
    return F.floor(x * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def cents(x: Column) -> Column:
    """A whole number of hundredths, so that sums don't depend on their order."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def falsy(x: Column, default: object) -> Column:
    """``x``, or ``default`` where it is null, empty or zero."""
    zero = F.lit("") if isinstance(default, str) else F.lit(0)
    return F.coalesce(F.nullif(x, zero), F.lit(default))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that holds, in the given order; null if none does."""
    return F.coalesce(*[F.when(failed, F.lit(code)) for failed, code in checks])


def every_failure(*checks: tuple[Column, str]) -> Column:
    """The codes of all checks that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(code)) for failed, code in checks]))


def pearson(x: str, y: str) -> Column:
    """Aggregate correlation; 0 for fewer than two rows or a constant column."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.when((F.count(x) >= 2) & (spread > 1e-9), F.try_divide(F.covar_pop(x, y), spread)), F.lit(0.0))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))
