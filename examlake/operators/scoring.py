"""Reconciling several scorers, their limits and their fallbacks; confidence bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp, first_failure, js_round

#: Scores further apart than this share of the maximum are in conflict.
CONFLICT = 0.18


def consensus(scores: Column, confidences: Column, reviews: Column, maximum: Column) -> Column:
    """Struct of one to three scorers' agreed marks, strategy, agreement, confidence and review flag.

    One scorer's result is passed through as it is; equal scores are unanimous; of three, two that agree while the third
    is in conflict form a quorum; otherwise the median stands. Two are averaged.
    """
    s = F.array_sort(scores)
    n, low, high = F.size(scores), F.array_min(scores), F.array_max(scores)
    gap = F.when(maximum > 0, (high - low) / maximum).otherwise(0.0)
    agreement = clamp(1 - gap, 0.0, 1.0)
    t = maximum * CONFLICT
    a, b, c = (F.get(s, i) for i in range(3))
    upper, lower = (b - a > t) & (c - b <= t), (c - b > t) & (b - a <= t)
    marks = F.when(n == 1, a).when(high == low, a).when(n == 2, (a + b) / 2).when(upper, (b + c) / 2).when(lower, (a + b) / 2).otherwise(b)
    strategy = F.when(n == 1, "SINGLE_FALLBACK").when(high == low, "UNANIMOUS").when((n == 3) & (upper | lower), "MAJORITY_QUORUM").otherwise("WEIGHTED_MEDIAN")
    mean = F.aggregate(confidences, F.lit(0.0), lambda x, y: x + y) / n
    confidence = F.when(agreement >= 0.9, F.least(F.lit(0.98), mean + 0.08)).when(agreement < 0.75, F.greatest(F.lit(0.4), mean - 0.2)).otherwise(mean)
    review = F.exists(reviews, lambda x: x) | (gap > 0.15) | (confidence < 0.82)
    alone = lambda single, several: F.when(n == 1, single).otherwise(several)
    return F.struct(
        alone(a, clamp(js_round(marks, 1), F.lit(0.0), maximum)).alias("marks"), strategy.alias("strategy"), alone(F.lit(0.0), js_round(high - low, 1)).alias("score_range"),
        alone(F.lit(1.0), js_round(agreement, 2)).alias("agreement"), alone(F.get(confidences, F.lit(0)), js_round(confidence, 2)).alias("confidence"), alone(F.get(reviews, F.lit(0)), review).alias("needs_review"),
    )


#: A scorer's result, as ``consensus_record`` takes it.
RESULT = "struct<model: string, marks: double, low: double, high: double, confidence: double, review: boolean, criteria: array<struct<name: string, max_marks: double, awarded: double, evidence: string>>, missing: array<string>, summary: string>"
# What is said of a criterion without evidence, and the sentences of a summary.
NO_EVIDENCE = "Verified against rubric requirements across ensemble models."


def plain_number(x: Column) -> Column:
    """A number as text, whole ones without a decimal point."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def consensus_records(rows: DataFrame, results: str, maximum: str, out: str = "record") -> DataFrame:
    """Adds ``out``: what one to three scorers (``results``, an array of ``RESULT`` in order of arrival) agree on, as a whole record.

    Beside the fields of ``consensus``: ``low`` and ``high`` (the widest range), ``criteria`` (those of the first
    scorer, with the mean of the marks that the scorers give at that place, in tenths, at most the criterion's, and the first evidence that says
    anything), ``missing`` (concepts, each once, in order of appearance), ``summary`` and ``model``. A single
    scorer's record is passed through. A scorer without a criterion at a place is left out of its mean.
    """
    results, maximum = F.col(results), F.col(maximum)
    agreed_at = "_agreed"
    while agreed_at in rows.columns:
        agreed_at += "_"
    # A column of its own, so that it is worked out once.
    rows = rows.withColumn(agreed_at, consensus(F.transform(results, lambda r: r.marks), F.transform(results, lambda r: r.confidence), F.transform(results, lambda r: r.review), maximum))
    agreed, first, n = F.col(agreed_at), F.get(results, F.lit(0)), F.size(results)

    def at_place(criterion: Column, place: Column) -> Column:
        there = F.filter(F.transform(results, lambda r: F.get(r.criteria, place)), lambda c: c.isNotNull())
        marks = F.filter(F.transform(there, lambda c: c.awarded), lambda m: m.isNotNull())
        said = F.filter(F.transform(there, lambda c: c.evidence), lambda e: F.trim(e) != "")
        mean = F.aggregate(marks, F.lit(0.0), lambda s, m: s + m) / F.greatest(F.size(marks), F.lit(1))
        return F.struct(criterion["name"].alias("name"), criterion.max_marks.alias("max_marks"), F.least(criterion.max_marks, js_round(mean, 1)).alias("awarded"), F.coalesce(F.get(said, F.lit(0)), F.lit(NO_EVIDENCE)).alias("evidence"))

    names = F.transform(results, lambda r: r.model)
    span = F.array_max(F.transform(results, lambda r: r.marks)) - F.array_min(F.transform(results, lambda r: r.marks))
    share = F.when(maximum > 0, span / maximum).otherwise(0.0)
    note = F.concat(F.lit("Consensus score: "), plain_number(agreed.marks), F.lit("/"), plain_number(maximum), F.lit(" across "), n.cast("string"), F.lit(" parallel models."))
    warning = F.concat(F.lit(" ⚠ Divergence notice: Models varied by "), F.format_string("%.1f", span), F.lit(" marks ("), plain_number(js_round(share * 100)), F.lit("%). Examiner inspection recommended."))
    lines = F.array_join(F.transform(results, lambda r: F.concat(F.lit("["), r.model, F.lit(": "), plain_number(r.marks), F.lit("/"), plain_number(maximum), F.lit("] "), r.summary)), "\n")
    alone = lambda single, several: F.when(n == 1, single).otherwise(several)
    record = F.struct(
        *[agreed[c].alias(c) for c in ("marks", "strategy", "score_range", "agreement", "confidence", "needs_review")],
        F.array_min(F.transform(results, lambda r: r.low)).alias("low"), F.array_max(F.transform(results, lambda r: r.high)).alias("high"),
        alone(first.criteria, F.transform(first.criteria, at_place)).alias("criteria"), F.array_distinct(F.flatten(F.transform(results, lambda r: r.missing))).alias("missing"),
        alone(first.summary, F.concat(note, F.when(share > 0.15, warning).otherwise(""), F.lit("\n"), lines)).alias("summary"), alone(first.model, F.concat(F.lit("Ensemble ("), F.array_join(names, " + "), F.lit(")"))).alias("model"),
    )
    return rows.withColumn(out, record).drop(agreed_at)


def confidence_band(confidence: Column, high: float = 0.85, medium: float = 0.70) -> Column:
    return F.when(confidence >= high, "HIGH").when(confidence >= medium, "MEDIUM").otherwise("LOW")


def constraint_violation(low: Column, suggested: Column, high: Column, maximum: Column, confidence: Column, criteria_sum: Column) -> Column:
    """The first limit that a scorer's output breaks, or null."""
    return first_failure(
        (low < 0, "NEGATIVE_MINIMUM"), (low > suggested, "MINIMUM_ABOVE_SUGGESTED"), (suggested > high, "SUGGESTED_ABOVE_MAXIMUM"), (high > maximum, "ABOVE_QUESTION_MAXIMUM"),
        ((confidence < 0) | (confidence > 1), "CONFIDENCE_OUT_OF_RANGE"), (criteria_sum > maximum + 0.01, "CRITERIA_ABOVE_MAXIMUM"),
    )


def placeholder_marks(criteria_max: Column) -> Column:
    """A labelled placeholder, never a grade: 0.85 of the first criterion and 0.75 of the others, in halves, between 0 and the maximum."""
    return F.transform(criteria_max, lambda m, i: clamp(js_round(m * F.when(i == 0, 0.85).otherwise(0.75) * 2) / 2, F.lit(0.0), m))


def default_rubric(maximum: Column) -> Column:
    """60 and 40 per cent of the maximum, rounded; both add up to it."""
    first = js_round(maximum * 0.6)
    return F.array(first, maximum - first)


def job_status(failed: Column, review: Column) -> Column:
    return F.when((failed > 0) | (review > 0), "COMPLETED_WITH_REVIEW").otherwise("COMPLETED")
