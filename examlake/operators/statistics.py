"""Distribution, correlation and sequence statistics over columns and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import pearson


def _bucketed(rows: DataFrame, keys: list[str], value: str, n_buckets: int, weight: Column | None = None) -> DataFrame:
    """Adds ``_b``, a range of ``value`` (equal values share one), and ``_before``, the rows of the group in the ranges before (or the sum of their ``weight``).

    So few groups, or one that holds most rows, are still ranked by many tasks. The bounds are
    ``n_buckets`` - 1 approximate quantiles of all rows; they decide how even the ranges are, never the ranks.
    """
    cuts = rows.select(F.percentile_approx(value, [k / n_buckets for k in range(1, n_buckets)], 1000)).first()[0] or []
    # A sum of comparisons: a filter of an array by a lambda would be carried over to the other side of the join, where the value isn't.
    at = reduce(lambda n, c: n + F.when(F.col(value) > float(c), 1).otherwise(0), sorted(set(cuts)), F.lit(0))
    marked = rows.withColumn("_b", at)
    # Columns of the sizes have names of their own, so the join is of two frames and not of one with itself.
    own = [f"_k{i}" for i in range(len(keys))]
    sizes = marked.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("_b").alias("_r")).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range of a group
    sizes = sizes.select(*own, "_r", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*own)).alias("_total"))
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)] + [F.col("_b") == F.col("_r")]
    return marked.join(sizes, on).drop(*own, "_r")


def ranked(rows: DataFrame, keys: list[str], value: str, tie: list[str], name: str, n_buckets: int = 64) -> DataFrame:
    """Adds ``name``, the row's place (from 1) in its group by ``value`` and then ``tie``, and ``_total``, the group's size."""
    w = Window.partitionBy(*keys, "_b").orderBy(value, *tie)
    return _bucketed(rows, keys, value, n_buckets).withColumn(name, F.col("_before") + F.row_number().over(w)).drop("_b", "_before")


def percentiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation by group; only the one or two rows that each needs are gathered."""
    placed = ranked(rows.where(F.col(value).isNotNull()), keys, value, [], "_r")
    out = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_total") - 1)
        low, high = (F.max(F.when(F.col("_r") - 1 == f(at), F.col(value).cast("double"))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*keys).agg(*out)


def gini(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """|2 sum(i x_i) / (n sum x) - (n + 1) / n| by group, x ascending, zeros included; 0 for one row or a zero sum."""
    s = ranked(rows, keys, value, [], "_i").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col("_i") * F.col(value)).alias("w"))
    g = F.abs(2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"))
    return s.select(*keys, F.when((F.col("n") > 1) & (F.col("s") != 0), g).otherwise(0.0).alias("gini"))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of the non-zero values of each group: mean, population deviation, least, greatest, quartiles, their distance and the coefficient of variation.

    Quartiles come from ranks by ranges of values, so a group may hold most of the rows.
    """
    x = F.when(F.col(value) != 0, F.col(value))
    sums = rows.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    quartiles = percentiles(rows.where(F.col(value) != 0), keys, value, {"p25": 0.25, "p75": 0.75})
    same = [sums[k].eqNullSafe(quartiles[k]) for k in keys]
    both = sums.join(quartiles, same, "left").select(*[sums[c] for c in sums.columns], "p25", "p75")
    return both.withColumns({"iqr": F.col("p75") - F.col("p25"), "cov": F.coalesce(F.try_divide("std", "mean"), F.lit(0.0))})


def mad_sigma(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median, by group; both medians from ranks by ranges of values."""
    away = rows.join(percentiles(rows, keys, value, {"_m": 0.5}), keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    return percentiles(away, keys, "_d", {"sigma": 0.5}).withColumn("sigma", F.col("sigma") * 1.4826)


def otsu_eta(rows: DataFrame, keys: list[str], value: str, threshold: str) -> DataFrame:
    """Share of the variance between the parts below and above each group's ``threshold``; at most 1, 0.5 where undefined."""
    low = F.col(value) < F.col(threshold)
    s = rows.groupBy(*keys).agg(
        F.avg(F.when(low, 1.0).otherwise(0.0)).alias("w0"), F.avg(F.when(low, F.col(value))).alias("m0"), F.avg(F.when(~low, F.col(value))).alias("m1"), F.var_pop(value).alias("v")
    )
    between = F.col("w0") * (1 - F.col("w0")) * F.pow(F.col("m0") - F.col("m1"), 2)
    return s.select(*keys, F.least(F.lit(1.0), F.coalesce(F.when(F.col("v") > 1e-12, F.try_divide(between, F.col("v"))), F.lit(0.5))).alias("eta"))


def ordinal_ranks(rows: DataFrame, keys: list[str], value: str, tie: str, name: str) -> DataFrame:
    return ranked(rows, keys, value, [tie], name).drop("_total").withColumn(name, F.col(name).cast("double"))


def value_ranks(rows: DataFrame, keys: list[str], value: str, name: str, n_buckets: int = 64) -> DataFrame:
    """The rank of each distinct value of a group, the mean of the places that its rows share: ``keys``, ``value`` and ``name``.

    Equal values are counted before they are ranked, so a value that most rows have is one row here.
    """
    tied = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    lower = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_before") + F.coalesce(F.sum("_c").over(lower), F.lit(0)) + (F.col("_c") + 1) / 2.0
    return _bucketed(tied, keys, value, n_buckets, F.col("_c")).select(*keys, value, rank.alias(name))


def with_ranks(rows: DataFrame, ranks: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the rank that :func:`value_ranks` gave to their value."""
    own = {c: f"_v{i}" for i, c in enumerate((*keys, value))}
    other = ranks.select(*[F.col(c).alias(o) for c, o in own.items()], name)
    return rows.join(other, [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()]).drop(*own.values())


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str, n_buckets: int = 64) -> DataFrame:
    """Ranks by group; equal values share the mean of their places."""
    return with_ranks(rows, value_ranks(rows, keys, value, name, n_buckets), keys, value, name)


def correlation(rows: DataFrame, keys: list[str], x: str, y: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(pearson(x, y).alias(name))


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``a``, ``b``, ``r`` for each pair of columns, all from one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def runs(rows: DataFrame, keys: list[str], order: str, active: Column) -> DataFrame:
    """Runs of active rows next to each other in ``order``: start, end and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = rows.withColumns({"_at": F.row_number().over(w), "_on": active}).where("_on")
    island = F.col("_at") - F.row_number().over(w)
    return at.withColumn("_run", island).groupBy(*keys, "_run").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("_run")


def peaks(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows above both neighbours and the group's mean, with the distance from the peak before."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = F.col(value)
    near = rows.withColumns({"_b": F.lag(value).over(w), "_a": F.lead(value).over(w), "_m": F.avg(value).over(Window.partitionBy(*keys))})
    top = near.where((x > F.col("_b")) & (x > F.col("_a")) & (x > F.col("_m"))).drop("_b", "_a", "_m")
    return top.withColumn("pitch", F.col(order) - F.lag(order).over(w))
