"""Assignment of books to examiners, and the capacity simulator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = 65536


def assign_least_loaded(books: DataFrame, examiners: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``book_id``, ``examiner_id``: books in ascending id go, one by one, to whoever has least load; the smaller id wins ties.

    ``examiners``: ``examiner_id``, ``load`` (whole). The k-th slot of an examiner opens at load + k;
    slots in ascending (level, examiner) are taken in the order of the books, which equals the greedy
    loop. Ranks are dealt by level, with offsets from the counts of levels, so no task sees all slots.
    Slots are opened up to the level at which they cover all books, so no book is left out.
    ``max_rounds``: the caller's own limit of slots for each examiner (a shortage leaves books out).
    """
    load = F.col("load").cast("bigint")
    if max_rounds is None:
        slots = examiners.crossJoin(F.broadcast(_water_level(books, examiners))).where(load < F.col("top"))
        last = F.col("top") - 1
    else:
        slots, last = examiners, load + max_rounds - 1
    # In two steps, so that no row holds more than a block of levels, however few the examiners are.
    blocks = slots.select("examiner_id", last.alias("last"), F.explode(F.sequence(load, last, F.lit(_BLOCK).cast("bigint"))).alias("first"))
    levels = F.sequence(F.col("first"), F.least(F.col("last"), F.col("first") + _BLOCK - 1))
    taken = _ranked(blocks.select("examiner_id", F.explode(levels).alias("level")), "level", "examiner_id")
    return _ranked(books.withColumn("level", F.floor(F.col("book_id") / 65536)), "level", "book_id").select("rank", "book_id").join(taken.select("rank", "examiner_id"), "rank").select("book_id", "examiner_id")


def _water_level(books: DataFrame, examiners: DataFrame) -> DataFrame:
    """One row, ``top``: the least level below which the examiners' slots cover all books.

    Below a level t there are max over loads v of (N * t - S) slots, N and S being the number and the sum of the loads up to v;
    so t is the least of ceil((books + S) / N).
    """
    w = Window.orderBy("load").rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct load
    loads = examiners.groupBy(F.col("load").cast("bigint").alias("load")).agg(F.count(F.lit(1)).alias("n"))
    sums = loads.select(F.sum("n").over(w).alias("n"), F.sum(F.col("n") * F.col("load")).over(w).alias("s"))
    wanted = books.agg(F.count(F.lit(1)).alias("books"))
    return sums.crossJoin(F.broadcast(wanted)).agg(F.min(F.ceil((F.col("books") + F.col("s")) / F.col("n"))).alias("top"))


def _ranked(rows: DataFrame, block: str, order: str) -> DataFrame:
    """A global rank in (``block``, ``order``): ranks inside blocks plus the sizes of the blocks before."""
    sizes = rows.groupBy(block).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(block, F.coalesce(F.sum("_n").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each block
    return rows.join(before, block).withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy(block).orderBy(order)))


def total_working_days(scripts: Column, daily_marking: Column, percent: Column, daily_moderation: Column) -> Column:
    """Days of marking, of moderation's lag where it has under 0.95 of what a day of marking sends, and one for the final audit. Capacities count as 1 at least."""
    marking, moderation = F.greatest(F.lit(1), daily_marking), F.greatest(F.lit(1), daily_moderation)
    days = F.ceil(scripts / marking)
    lag = F.ceil(F.ceil(scripts * percent / 100.0) / moderation) - days
    short = moderation / F.greatest(F.lit(1), F.ceil(marking * percent / 100.0)) < 0.95
    return (days + F.when(short & (lag > 0), lag).otherwise(0) + 1).cast("int")


def timeline(spark: SparkSession, days: int | Column, scripts: Column, daily_marking: Column, percent: Column, daily_moderation: Column, scenarios: DataFrame) -> DataFrame:
    """For each scenario and day: scripts marked, moderated and waiting for moderation, in closed form.

    Moderation takes ``percent`` of what is marked and starts on the second day.
    """
    each = scenarios.withColumn("day", F.explode(F.sequence(F.lit(0), days if isinstance(days, Column) else F.lit(days))))
    marked = F.least(scripts, F.col("day") * daily_marking)
    sent = F.ceil(marked * percent / 100.0)
    moderated = F.when(F.col("day") < 2, F.lit(0)).otherwise(F.least(sent, (F.col("day") - 1) * daily_moderation))
    return each.withColumns({"marked": marked.cast("bigint"), "moderated": moderated.cast("bigint")}).withColumn("backlog", F.greatest(F.lit(0), sent - F.col("moderated")).cast("bigint"))


def bottleneck(moderation_ratio: Column, days: Column, pace: Column) -> Column:
    """MODERATION below 0.95 of what is needed, EVALUATION beyond 22 days, LOAD above 34 a day; the first that holds."""
    return F.when(moderation_ratio < 0.95, "MODERATION").when(days > 22, "EVALUATION").when(pace > 34, "LOAD").otherwise("NONE")


def working_days(start: Column, n_days: Column, week: int = 5) -> Column:
    """The first ``n_days`` working dates after ``start`` (5: Monday to Friday, 6: Saturday too)."""
    span = F.sequence(F.date_add(start, 1), F.date_add(start, (n_days * 2 + 10).cast("int")))
    off = [1] if week == 6 else [1, 7]
    return F.slice(F.filter(span, lambda d: ~F.dayofweek(d).isin(off)), 1, n_days)
