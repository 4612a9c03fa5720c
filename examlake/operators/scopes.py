"""Optional filters, row scopes, guarded writes, issue records and small rules as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import every_failure

# What the moderation queue shows without a status, and for ALL.
QUEUE, QUEUE_ALL = ("SUBMITTED", "UNDER_REVIEW"), ("SUBMITTED", "UNDER_REVIEW", "APPROVED", "RETURNED")


def filtered(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns equal what is given; None and ``ALL`` stand for no filter."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in equal.items() if v is not None and v != "ALL"), rows)


def in_scope(rows: DataFrame, role: str, own: Column) -> DataFrame:
    """An examiner sees the rows that are ``own``; other roles see all."""
    return rows.where(own) if role == "EXAMINER" else rows


def queue_mode(status: Column, mode: str | None) -> Column:
    """Whether the queue shows a row: without a mode what waits, for ALL what ever waited, else that status."""
    return status.isin(*QUEUE) if mode is None else status.isin(*QUEUE_ALL) if mode == "ALL" else status == mode


def updated(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The table after an update; ``_changed`` tells which rows it met (a null condition meets none)."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumn("_changed", hit).withColumns({c: F.when(F.col("_changed"), v).otherwise(F.col(c)) for c, v in values.items()})


def deletable(rows: DataFrame, used: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that nothing in ``used`` refers to, the others)."""
    return rows.join(used, key, "left_anti"), rows.join(used, key, "left_semi")


def record(rule: str, name: str, severity: str, key: Column, examiner: Column, description: Column) -> Column:
    """An issue as a struct of the shape that all rules share."""
    return F.struct(F.concat(F.lit(f"{rule}-"), key).alias("issue_id"), F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"), F.col("evaluation_id"), F.coalesce("exam", F.lit("—")).alias("exam_code"), examiner.alias("examiner"), description.alias("description"))


def issues(rows: DataFrame, *rules: tuple[Column, Column], also: Sequence[str] = ()) -> DataFrame:
    """The records of all rules that hold, from one pass over ``rows``; they take the columns ``also`` along."""
    found = F.array(*[F.when(holds, made) for holds, made in rules])  # compacting would leave compiled code
    return rows.select(F.explode(found).alias("i"), *also).where("i is not null").select("i.*", *also)


def unreadable(has_image: Column, has_text: Column, confidence: Column, least: float = 0.35) -> Column:
    """No image, and no text or one that was hardly read."""
    return ~has_image & (~has_text | (confidence < least))


def identity(raw: Column) -> Column:
    return F.nullif(F.lower(F.trim(raw)), F.lit(""))


def same_identity(a: Column, b: Column) -> Column:
    return F.coalesce(identity(a) == identity(b), F.lit(False))


def content_sufficiency(strokes: Column, share: Column, least_share: float = 0.0005) -> Column:
    """Under 350 stroke pixels, or under the least share of the page: too sparse."""
    return F.when((strokes < 350) | (share < least_share), "SPARSE").otherwise("SUFFICIENT")


def condition_flags(shadow: Column, contrast: Column, noise: Column, sharpness: Column) -> Column:
    """Contrast below 52, noise above 8, sharpness below 42; none: clean."""
    return every_failure((shadow, "SHADOW"), (contrast < 52, "LOW_CONTRAST"), (noise > 8, "NOISE"), (sharpness < 42, "SOFT"))
