import datetime
import math

import pytest
from pyspark.sql import functions as F

from examlake.functions.expr import clamp, falsy, js_round
from examlake.operators import planning, rules, scoring, vision
from examlake.plans import scoring as scoring_plans


def js(x, n):
    return math.floor(x * 10**n + 0.5) / 10**n


def test_rounding_and_defaults(spark):
    values = [2.5, -2.5, 0.125, 1.005, 89.994, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", js_round(F.col("x"), 2).alias("r")).collect()
    assert [r.r for r in rows] == [js(v, 2) for v in values]
    row = spark.sql("select 0 as a, '' as b, cast(null as string) as c, 5 as d").select(falsy(F.col("a"), 7).alias("a"), falsy(F.col("b"), "—").alias("b"), falsy(F.col("c"), "x").alias("c"), falsy(F.col("d"), 7).alias("d"), clamp(F.col("d"), 0, 3).alias("e")).first()
    assert tuple(row) == (7, "—", "x", 5, 3)


def test_grade_table(spark):
    table = [(100.0, "A+", 10), (90.0, "A+", 10), (89.995, None, None), (89.994, "A", 9), (80.0, "A", 9), (70.0, "B+", 8), (60.0, "B", 7), (50.0, "C", 6), (40.0, "P", 4), (39.99, "F", 0), (0.0, "F", 0)]
    name, point, kind = rules.grade(F.col("p"))
    got = spark.createDataFrame([(p,) for p, _, _ in table], "p double").select("p", name.alias("g"), point.alias("n"), kind.alias("k")).collect()
    for r, (p, g, n) in zip(got, table, strict=True):
        if g is None:
            g, n = ("A+", 10) if js(p, 2) >= 90 else ("A", 9)
        assert (r.g, r.n) == (g, n), p
    assert [r.k for r in got][-1] == "FAIL"


MARKS = "evaluation_id long, question_number int, question_id long, moderator_id long, marks double, amount double, mark_status string, reviewed boolean, marked_at timestamp"


def mark(question, number, marks, status, evaluation=1, amount=1.0):
    return (evaluation, number, question, 1, marks, amount, status, True, None)


def test_first_failure_wins(spark):
    questions = spark.createDataFrame([(1, 20), (2, 30), (3, 50)], "question_id long, max_marks int")
    cases = {
        1: ([mark(1, 1, 10.0, "MARKED", 1), mark(2, 2, 30.0, "FLAGGED", 1)], None),
        2: ([mark(1, 1, 10.0, "MARKED", 2, 1.0), mark(1, 1, 11.0, "MARKED", 2, 2.0)], "DUPLICATE_QUESTION"),
        3: ([mark(9, 1, 1.0, "MARKED", 3)], "UNKNOWN_QUESTION"),
        4: ([mark(1, 1, 1.0, "ODD", 4)], "BAD_STATUS"),
        5: ([mark(1, 1, float("nan"), "MARKED", 5)], "NOT_A_NUMBER"),
        6: ([mark(1, 1, -1.0, "MARKED", 6)], "NEGATIVE"),
        7: ([mark(1, 1, 20.5, "MARKED", 7)], "ABOVE_MAXIMUM"),
        8: ([mark(1, 1, 1.0, "NOT_ATTEMPTED", 8)], "NOT_ATTEMPTED_WITH_MARKS"),
        9: ([mark(1, 1, 1.0, "NOT_STARTED", 9)], "NOT_STARTED_WITH_MARKS"),
        10: ([mark(1, 2, -1.0, "MARKED", 10), mark(2, 1, 31.0, "MARKED", 10)], "ABOVE_MAXIMUM"),
    }
    rows = spark.createDataFrame([r for rs, _ in cases.values() for r in rs], MARKS)
    got = {r.evaluation_id: r.code for r in rules.first_failures(rows, questions).collect()}
    assert got == {k: c for k, (_, c) in cases.items() if c}


def test_book_transitions(spark):
    states = list(rules.BOOK_NEXT)
    steps = spark.createDataFrame([(a, b) for a in states for b in states] + [(None, "READY")], "before string, after string")
    illegal = {(r.before, r.after) for r in rules.illegal_steps(steps, rules.BOOK_NEXT).collect()}
    assert illegal == {(a, b) for a in states for b in states if a != b and b not in rules.BOOK_NEXT[a]}


@pytest.mark.parametrize(
    ("scores", "maximum", "marks", "strategy"),
    [
        ([8.5, 8.5, 8.5], 10, 8.5, "UNANIMOUS"), ([9.0, 8.5, 4.0], 10, 8.8, "MAJORITY_QUORUM"), ([9.0, 6.0], 10, 7.5, "WEIGHTED_MEDIAN"), ([7.0], 10, 7.0, "SINGLE_FALLBACK"), ([2.0, 5.0, 9.0], 10, 5.0, "WEIGHTED_MEDIAN"),
        ([1.0, 2.0, 9.0], 10, 1.5, "MAJORITY_QUORUM"), ([0.0, 0.0], 0, 0.0, "UNANIMOUS"), ([12.0], 10, 12.0, "SINGLE_FALLBACK"),  # passed through as it is
    ],
)
def test_consensus_cases(spark, scores, maximum, marks, strategy):
    rows = spark.createDataFrame([(scores, [0.9] * len(scores), [False], float(maximum))], "s array<double>, c array<double>, r array<boolean>, m double")
    got = rows.select(scoring.consensus(F.col("s"), F.col("c"), F.col("r"), F.col("m")).alias("x")).first().x
    assert (got.marks, got.strategy) == (marks, strategy)
    assert got.needs_review == (maximum > 0 and (max(scores) - min(scores)) / maximum > 0.15)


def test_constraints_and_placeholders(spark):
    row = spark.range(1).select(
        scoring.constraint_violation(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(5.0), F.lit(0.9), F.lit(5.0)).alias("ok"),
        scoring.constraint_violation(F.lit(1.0), F.lit(2.0), F.lit(6.0), F.lit(5.0), F.lit(0.9), F.lit(5.0)).alias("high"),
        scoring.constraint_violation(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(5.0), F.lit(1.2), F.lit(5.0)).alias("conf"),
        scoring.placeholder_marks(scoring.default_rubric(F.lit(10.0))).alias("p"),
    ).first()
    assert (row.ok, row.high, row.conf, row.p) == (None, "ABOVE_QUESTION_MAXIMUM", "CONFIDENCE_OUT_OF_RANGE", [5.0, 3.0])


def test_assignment_equals_the_greedy_loop(spark):
    loads = {1: 3, 2: 0, 3: 0, 4: 7}
    books = list(range(100, 125))
    want, now = {}, dict(loads)
    for b in books:
        who = min(now, key=lambda e: (now[e], e))
        want[b], now[who] = who, now[who] + 1
    got = planning.assign_least_loaded(spark.createDataFrame([(b,) for b in books], "book_id long"), spark.createDataFrame(list(loads.items()), "examiner_id long, load int"), 40)
    assert {r.book_id: r.examiner_id for r in got.collect()} == want


def test_timelines_run_to_the_end_of_marking_and_moderation(spark, monkeypatch):
    exams = {"LONG": (400, 10), "SHORT": (30, 10), "SLOW": (7, 1), "EVEN": (4000, 40)}
    rows = spark.createDataFrame([(k, n, p, datetime.date(2024, 3, 1)) for k, (n, p) in exams.items()], "exam string, scripts long, people long, start date")
    monkeypatch.setattr(scoring_plans, "scenarios", lambda *_: rows)
    curve, dates = scoring_plans.timeline_curve(spark, "").collect(), scoring_plans.timeline_calendar(spark, "").collect()
    for exam, (n, p) in exams.items():
        moderators, marking, sampled = max(1, p // 4), math.ceil(n / p), math.ceil(n * 30 / 100)
        lag = math.ceil(sampled / moderators) - marking if moderators / max(1, math.ceil(p * 30 / 100)) < 0.95 else 0
        total = marking + max(0, lag) + 1
        mine = {r.day: r for r in curve if r.exam == exam}
        assert sorted(mine) == list(range(max(30, total) + 1)) and mine[total].marked == n
        assert exam == "SLOW" or (mine[total].moderated, mine[total].backlog) == (sampled, 0)
        days = sorted((r.number, r.working_date) for r in dates if r.exam == exam)
        assert [k for k, _ in days] == list(range(1, max(20, total) + 1)) and all(d.weekday() < 5 for _, d in days)


def test_working_days_skip_week_ends(spark):
    row = spark.sql("select date'2024-03-01' as d").select(planning.working_days(F.col("d"), F.lit(3)).alias("five"), planning.working_days(F.col("d"), F.lit(3), 6).alias("six")).first()
    assert [d.day for d in row.five] == [4, 5, 6] and [d.day for d in row.six] == [2, 4, 5]


def test_assignment_leaves_no_book_out(spark, monkeypatch):
    people, books = [3, 6, 13, 14], list(range(500, 730))
    monkeypatch.setattr(scoring_plans.domain, "evaluations", lambda *_: spark.createDataFrame([(b, "IN_PROGRESS") for b in books], "evaluation_id long, status string"))
    monkeypatch.setattr(scoring_plans.domain, "examiners", lambda *_: spark.createDataFrame([(p,) for p in people], "examiner_id long"))
    want, now = {}, {p: p % 7 for p in people}
    for b in books:
        who = min(now, key=lambda e: (now[e], e))
        want[b], now[who] = who, now[who] + 1
    assert {r.book_id: r.examiner_id for r in scoring_plans.auto_assign_slots(spark, "").collect()} == want


def test_slots_open_only_up_to_the_level_that_covers_the_books(spark):
    for loads, n, top in (([0, 0, 9], 4, 2), ([0, 0, 9], 21, 10), ([5, 7], 0, 5), ([2], 70000, 70002)):
        books, people = spark.range(n).select(F.col("id").alias("book_id")), spark.createDataFrame(list(enumerate(loads)), "examiner_id long, load int")
        assert planning._water_level(books, people).first().top == top
        assert planning.assign_least_loaded(books, people).count() == n


def test_a_single_scorer_is_passed_through(spark):
    row = spark.sql("select array(7.34D) as s, array(0.6D) as c, array(false) as r, 10D as m")
    got = row.select(scoring.consensus(F.col("s"), F.col("c"), F.col("r"), F.col("m")).alias("x")).first().x
    assert (got.marks, got.confidence, got.needs_review, got.agreement, got.score_range, got.strategy) == (7.34, 0.6, False, 1.0, 0.0, "SINGLE_FALLBACK")


def test_whole_records_of_scorers(spark):
    one = ("m1", 8.0, 7.0, 9.0, 0.9, False, [("Method", 6.0, 5.0, " "), ("Result", 4.0, 3.0, "shown")], ["heap", "stack"], "good")
    two = ("m2", 6.0, 5.5, 8.0, 0.8, False, [("Method", 6.0, 9.0, "steps")], ["stack", "queue"], "fair")
    rows = spark.createDataFrame([(1, [one, two], 10.0), (2, [two], 10.0), (3, [one, one, one], 10.0)], f"k int, results array<{scoring.RESULT}>, m double")
    got = {r.k: r.record for r in scoring.consensus_records(rows, "results", "m").collect()}
    both = got[1]
    assert (both.marks, both.low, both.high, both.agreement, both.confidence, both.needs_review) == (7.0, 5.5, 9.0, 0.8, 0.85, True)
    assert [tuple(c) for c in both.criteria] == [("Method", 6.0, 6.0, "steps"), ("Result", 4.0, 3.0, "shown")] and both.missing == ["heap", "stack", "queue"] and both.model == "Ensemble (m1 + m2)"
    assert both.summary == "Consensus score: 7/10 across 2 parallel models. ⚠ Divergence notice: Models varied by 2.0 marks (20%). Examiner inspection recommended.\n[m1: 8/10] good\n[m2: 6/10] fair"
    assert (got[2].marks, got[2].confidence, got[2].needs_review, got[2].model, got[2].summary) == (6.0, 0.8, False, "m2", "fair") and [tuple(c) for c in got[2].criteria] == [("Method", 6.0, 9.0, "steps")]
    assert got[3].strategy == "UNANIMOUS" and got[3].summary.startswith("Consensus score: 8/10 across 3 parallel models.\n[m1") and got[3].criteria[0].evidence == scoring.NO_EVIDENCE


def test_guidance_and_checklist(spark):
    row = spark.sql("select array('FATAL_INK_LOSS', 'ODD') as fatal, array('Skew', 'Faint strokes', 'Small glyphs') as risks, 8.26D as skew, 0.4D as faint_fraction")
    says, asks = row.select(vision.guidance(F.col("fatal")), vision.checklist(F.col("risks"), {"skew": F.col("skew"), "faint_fraction": F.col("faint_fraction")})).first()
    assert says == "Handwriting contrast too faint. Ensure well-lit capture or request student use dark pen. | Address physical defect: ODD"
    assert asks == ["Inspect text baseline tilt (8.3°). Confirm line grouping is intact.", "Inspect faint stroke segments (faint stroke ratio: 40.0%). Check pencil markings.", "Inspect document condition regarding: Small glyphs"]


def test_marks_are_dealt_by_what_there_is_to_read(spark):
    """A table of many parts gives more shares than the session shuffles into, and a book's marks are together."""
    from examlake.functions.shares import SHARES
    from examlake.operators import rules as operators
    from examlake.sources import domain

    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        marks, questions = domain.marks(spark, "/root/testdata/sf0.01"), domain.questions(spark, "/root/testdata/sf0.01")
        parts = marks.rdd.getNumPartitions()
        rows = operators.with_maximum(marks, questions)
        assert parts > 1 and rows.rdd.getNumPartitions() == SHARES * parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert rows.count() == marks.count() and rows.selectExpr("evaluation_id", "spark_partition_id() AS p").distinct().groupBy("evaluation_id").count().where("count > 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
