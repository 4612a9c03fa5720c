"""Operational dashboards, queues and rosters as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cents, js_round

DONE = ("SUBMITTED", "APPROVED")


def status_counts(rows: DataFrame, column: str, statuses: tuple[str, ...], total: str = "total") -> DataFrame:
    """One row: a count for each status (absent: 0) and the number of rows."""
    return rows.agg(*[F.count_if(F.col(column) == s).alias(s.lower()) for s in statuses], F.count(F.lit(1)).alias(total))


def examiner_analytics(examiners: DataFrame, evaluations: DataFrame, marks: DataFrame) -> DataFrame:
    """Assigned, completed, returned, flags (each return is one), mean total and mean positive minutes for each examiner; zeros where there is nothing.

    Marks are pre-aggregated by evaluation, evaluations by examiner; no count is correlated.
    """
    by_evaluation = marks.groupBy("evaluation_id").agg(F.count_if(F.col("mark_status") == "FLAGGED").alias("flags"), F.max("marked_at").alias("submitted_at"))
    done = F.col("status").isin(*DONE)
    minutes = F.timestamp_diff("MINUTE", F.col("started_at").cast("timestamp"), F.col("submitted_at").cast("timestamp"))
    worked = done & (minutes > 0)
    stats = (
        evaluations.join(by_evaluation, "evaluation_id", "left")
        .groupBy("examiner_id")
        .agg(
            F.count(F.lit(1)).alias("assigned"),
            F.count_if(done).alias("completed"),
            F.count_if(F.col("status") == "RETURNED").alias("returned"),
            (F.sum(F.when(done, F.coalesce("flags", F.lit(0))).otherwise(0)) + F.count_if(F.col("status") == "RETURNED")).alias("flags"),
            F.sum(F.when(done, cents(F.col("total_marks")))).alias("_cents"),
            F.sum(F.when(worked, minutes)).alias("_minutes"),
            F.count_if(worked).alias("_worked"),
        )
    )
    average = F.when(F.col("completed") > 0, js_round(F.col("_cents") / (F.col("completed") * 100.0), 1))
    duration = F.when(F.col("_worked") > 0, js_round(F.col("_minutes") / F.col("_worked").cast("double")))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    return examiners.join(stats, "examiner_id", "left").select(
        "examiner_id", "examiner_name", zero(F.col("assigned"), "bigint").alias("assigned"), zero(F.col("completed"), "bigint").alias("completed"),
        zero(F.col("returned"), "bigint").alias("returned"), zero(F.col("flags"), "bigint").alias("flags"), zero(average, "double").alias("average_marks"), zero(duration, "double").alias("average_minutes"),
    )


def capacity_band(load: Column) -> Column:
    return F.when(load >= 5, "AT_CAPACITY").when(load >= 2, "MODERATE").otherwise("AVAILABLE")


def page(rows: DataFrame, order: list[Column], number: int = 1, limit: int = 50) -> DataFrame:
    """Rows of the ``number``-th page; ``order`` should end in a unique column."""
    return rows.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_meta(rows: DataFrame, limit: int = 50) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / limit).alias("total_pages")).withColumn("page_limit", F.lit(limit))


def search(rows: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows of which any column contains ``term``, whatever the case; an empty term keeps all."""
    if not term:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.lower()))
    return rows.where(hit)


def latest_per_group(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")
