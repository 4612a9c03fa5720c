"""Student's t of correlations as column expressions, and many metrics against one target from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import pearson
from .statistics import value_ranks, with_ranks


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a > 0: a series in 1/a that is good from 16 on, brought back step by step below."""
    far = a + 16.0
    # Coefficients of the asymptotic series.
    series = 1.0 + sum((c * F.pow(far, F.lit(-float(k))) for k, c in enumerate((-1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432), 1)), F.lit(0.0))
    ratio = F.sqrt(far) * series
    for i in range(16):
        ratio = ratio * (a + float(i)) / (a + (i + 0.5))
    return ratio


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by two steps for each m; more of them where a and b are large."""
    steps = F.sequence(F.lit(1), F.least(F.lit(20_000), F.lit(60) + 4 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    first = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    state = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(s: Column, k: Column) -> Column:
        d, c = 1.0 / safe(1.0 + k * s.d), safe(1.0 + k / s.c)
        return F.struct(c.alias("c"), d.alias("d"), (s.h * d * c).alias("h"))

    def even(s: Column, m: Column) -> Column:
        return half(s, m * (b - m) * x / ((a - 1.0 + 2.0 * m) * (a + 2.0 * m)))

    def odd(s: Column, m: Column) -> Column:
        return half(s, -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 1.0 + 2.0 * m)))

    # Both halves of a step are steps of their own, so that no expression is written twice into another.
    halves = F.flatten(F.transform(steps, lambda m: F.array(F.struct(m.cast("double").alias("m"), F.lit(True).alias("even")), F.struct(m.cast("double").alias("m"), F.lit(False).alias("even")))))
    return F.aggregate(halves, state, lambda s, k: F.when(k.even, even(s, k.m)).otherwise(odd(s, k.m)), lambda s: s.h)


def t_two_sided(r: Column, n: Column) -> Column:
    """Chance of a correlation as far from 0 as ``r`` over ``n`` rows if there is none; null under 3 rows or where ``r`` is null, 0 at r = 1 or -1."""
    a, b = (n - 2).cast("double") / 2.0, F.lit(0.5)
    x, y = 1.0 - r * r, r * r
    front = F.exp(a * F.log(F.greatest(x, F.lit(1e-300)))) * F.sqrt(y) * _gamma_ratio(a) / F.sqrt(F.lit(3.141592653589793))
    inner = F.when(x < (a + 1.0) / (a + 2.5), front * _fraction(a, b, x) / a).otherwise(1.0 - front * _fraction(b, a, y) / b)
    return F.when(r.isNull() | (n < 3), F.lit(None).cast("double")).when(F.abs(r) >= 1.0, 0.0).when(r == 0.0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner)))


def sweep(rows: DataFrame, metrics: list[str], target: str) -> DataFrame:
    """``metric``, ``n``, ``r``, ``rho`` (ranks of ties shared) and their ``r_p`` and ``rho_p`` of each metric against ``target``.

    Rows without the metric or the target are left out of that metric. A metric or target that is constant has 0 for both
    and no chance is small: its p is 1. All metrics are one unpivoted table, ranked by ranges of distinct values; ``rows`` is read several times.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    long = rows.select(F.explode(cells).alias("c"), F.col(target).cast("double").alias("y")).select("c.metric", "c.x", "y").where("x is not null and y is not null")
    ranked = long
    for value, name in (("x", "rx"), ("y", "ry")):
        ranked = with_ranks(ranked, value_ranks(long, ["metric"], value, name), ["metric"], value, name)
    out = ranked.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("r"), pearson("rx", "ry").alias("rho"))
    return out.withColumns({"r_p": t_two_sided(F.col("r"), F.col("n")), "rho_p": t_two_sided(F.col("rho"), F.col("n"))})
