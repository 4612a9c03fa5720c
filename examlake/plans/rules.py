"""Queries of the rule engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import cents, every_failure, first_failure, js_round, ratio
from ..operators import rules as ops
from ..sources import domain
from ..sources.domain import SQL as D
from .registry import registry

QUERIES, ORACLE, query = registry()

_C = "CAST(floor({} * 100 + 0.5) AS BIGINT)"
_DUP = "SELECT 'duplicate-' || evaluation_id || '-' || question_number AS issue_id, 'duplicate' AS rule, 'HIGH' AS severity, evaluation_id, CAST(count(*) AS VARCHAR) AS detail FROM marks GROUP BY evaluation_id, question_number HAVING count(*) > 1"
_OVER = f"SELECT 'over-maximum-' || evaluation_id AS issue_id, 'over-maximum' AS rule, 'HIGH' AS severity, evaluation_id, c || '/' || m AS detail FROM (SELECT evaluation_id, sum({_C.format('marks')}) AS c, sum(max_marks) AS m FROM marks JOIN questions USING (question_id) GROUP BY 1) JOIN evaluations USING (evaluation_id) WHERE c > m * 100"
_ARITH = f"SELECT 'arithmetic-' || evaluation_id AS issue_id, 'arithmetic' AS rule, 'MEDIUM' AS severity, evaluation_id, CAST(abs(c - {_C.format('total_marks')}) AS VARCHAR) AS detail FROM evaluations JOIN (SELECT evaluation_id, sum({_C.format('amount')}) AS c FROM marks GROUP BY 1) USING (evaluation_id) WHERE abs(c - {_C.format('total_marks')}) > 1"
_MARK = "SELECT {rule} || '-' || evaluation_id || '-' || question_number || '-' || question_id AS issue_id, {rule} AS rule, 'HIGH' AS severity, evaluation_id, printf('%.2f', marks) AS detail FROM marks LEFT JOIN questions USING (question_id) WHERE {where}"
_NEG, _RUB, _NOT = (_MARK.format(rule=f"'{r}'", where=w) for r, w in (("negative", "marks < 0"), ("over-rubric", "marks > max_marks"), ("not-attempted-with-marks", "mark_status = 'NOT_ATTEMPTED' AND marks <> 0")))
_INC = "SELECT 'incomplete-' || evaluation_id AS issue_id, 'incomplete' AS rule, 'HIGH' AS severity, evaluation_id, n || '/' || top AS detail FROM evaluations JOIN (SELECT evaluation_id, count(DISTINCT question_number) FILTER (mark_status IN ('MARKED', 'FLAGGED', 'NOT_ATTEMPTED')) AS n, max(question_number) AS top FROM marks GROUP BY 1) USING (evaluation_id) WHERE status IN ('SUBMITTED', 'UNDER_REVIEW', 'APPROVED') AND n < top"
_RES = "SELECT 'rescan-breach-' || evaluation_id AS issue_id, 'rescan-breach' AS rule, 'HIGH' AS severity, evaluation_id, status AS detail FROM evaluations WHERE quality_status = 'RESCAN_REQUIRED' AND status IN ('IN_PROGRESS', 'SUBMITTED', 'UNDER_REVIEW', 'APPROVED')"
_BOOK = "CASE paper_set WHEN '1-URGENT' THEN 'APPROVED' WHEN '2-HIGH' THEN 'SUBMITTED' WHEN '3-MEDIUM' THEN 'FINALIZED' WHEN '4-NOT SPECIFIED' THEN 'UNDER_REVIEW' ELSE 'RETURNED' END"
_CUS = f"SELECT 'custody-' || evaluation_id AS issue_id, 'custody' AS rule, 'HIGH' AS severity, evaluation_id, status || '/' || book AS detail FROM (SELECT *, {_BOOK} AS book FROM evaluations) WHERE NOT CASE status WHEN 'APPROVED' THEN book IN ('APPROVED', 'FINALIZED') WHEN 'RETURNED' THEN book = 'RETURNED' WHEN 'SUBMITTED' THEN book IN ('SUBMITTED', 'UNDER_REVIEW') ELSE true END"
_ALL = " UNION ALL ".join((_DUP, _OVER, _ARITH, _NEG, _RUB, _NOT, _INC, _RES, _CUS))


def book_status():
    """A book's state; the tables have none of its own, so the priority stands in for it."""
    p = F.col("paper_set")
    return F.when(p == "1-URGENT", "APPROVED").when(p == "2-HIGH", "SUBMITTED").when(p == "3-MEDIUM", "FINALIZED").when(p == "4-NOT SPECIFIED", "UNDER_REVIEW").otherwise("RETURNED")


@query(D + _DUP)
def integrity_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duplicate_marks(domain.marks(spark, sf_dir))


@query(D + _OVER)
def integrity_total_over_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.total_over_maximum(domain.evaluations(spark, sf_dir), domain.marks(spark, sf_dir), domain.questions(spark, sf_dir))


@query(D + _ARITH)
def integrity_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.arithmetic_gap(domain.evaluations(spark, sf_dir), domain.marks(spark, sf_dir))


@query(D + f"{_NEG} UNION ALL {_RUB} UNION ALL {_NOT}")
def integrity_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.per_mark(domain.marks(spark, sf_dir), domain.questions(spark, sf_dir))


@query(D + _INC)
def integrity_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.incomplete(domain.evaluations(spark, sf_dir), domain.marks(spark, sf_dir))


@query(D + _CUS)
def integrity_custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.custody(domain.evaluations(spark, sf_dir), book_status())


@query(D + _ALL)
def integrity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, mk, qs = domain.evaluations(spark, sf_dir), domain.marks(spark, sf_dir), domain.questions(spark, sf_dir)
    return ops.all_issues(ops.issues_of_marks(ev, mk, qs), ops.rescan_breach(ev), ops.custody(ev, book_status()))


@query(D + f"SELECT severity, rule, count(*) AS n, count(DISTINCT evaluation_id) AS evaluations FROM ({_ALL}) GROUP BY severity, rule")
def integrity_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity_all(spark, sf_dir).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("evaluation_id").alias("evaluations"))


_FAIL = """, r AS (SELECT m.*, q.max_marks, row_number() OVER (PARTITION BY evaluation_id, question_number ORDER BY question_id, moderator_id, marks, amount) AS pos
  FROM marks m LEFT JOIN questions q USING (question_id)),
f AS (SELECT *, CASE WHEN pos > 1 THEN 'DUPLICATE_QUESTION' WHEN max_marks IS NULL THEN 'UNKNOWN_QUESTION'
  WHEN mark_status IS NULL OR mark_status NOT IN ('NOT_STARTED', 'MARKED', 'FLAGGED', 'NOT_ATTEMPTED') THEN 'BAD_STATUS' WHEN marks IS NULL THEN 'NOT_A_NUMBER' WHEN marks < 0 THEN 'NEGATIVE'
  WHEN marks > max_marks THEN 'ABOVE_MAXIMUM' WHEN mark_status = 'NOT_ATTEMPTED' AND marks <> 0 THEN 'NOT_ATTEMPTED_WITH_MARKS' WHEN mark_status = 'NOT_STARTED' AND marks <> 0 THEN 'NOT_STARTED_WITH_MARKS' END AS code FROM r)
"""


@query(D + _FAIL + """SELECT evaluation_id, question_number, code, failing_rows FROM (
SELECT evaluation_id, question_number, code, count(*) OVER (PARTITION BY evaluation_id) AS failing_rows, row_number() OVER (PARTITION BY evaluation_id ORDER BY question_number, pos) AS k FROM f WHERE code IS NOT NULL) WHERE k = 1""")  # fmt: skip
def mark_validation_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_failures(domain.marks(spark, sf_dir), domain.questions(spark, sf_dir))


@query(D + _FAIL + """, s AS (SELECT evaluation_id, count(code) AS failed, count(DISTINCT question_number) AS n, max(question_number) AS top, count(*) FILTER (NOT reviewed) AS unreviewed FROM f GROUP BY 1)
SELECT evaluation_id, CASE WHEN failed > 0 THEN 'INVALID_MARKS' WHEN n < top THEN 'MISSING_QUESTIONS' WHEN unreviewed > 0 THEN 'UNREVIEWED' ELSE 'OK' END AS outcome, unreviewed FROM s""")  # fmt: skip
def mark_validation_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.mark_failures(domain.marks(spark, sf_dir), domain.questions(spark, sf_dir))
    sums = rows.groupBy("evaluation_id").agg(F.count("code").alias("failed"), F.count_distinct("question_number").alias("n"), F.max("question_number").alias("top"), F.count_if(~F.col("reviewed")).alias("unreviewed"))
    outcome = first_failure((F.col("failed") > 0, "INVALID_MARKS"), (F.col("n") < F.col("top"), "MISSING_QUESTIONS"), (F.col("unreviewed") > 0, "UNREVIEWED"))
    return sums.select("evaluation_id", F.coalesce(outcome, F.lit("OK")).alias("outcome"), "unreviewed")


@query(D + """SELECT evaluation_id, count(*) FILTER (mark_status IN ('MARKED', 'FLAGGED')) AS evaluated, count(*) FILTER (mark_status = 'NOT_ATTEMPTED') AS not_attempted, count(*) FILTER (mark_status = 'FLAGGED') AS flagged,
array_to_string(list_sort(list_distinct(list(question_number) FILTER (mark_status = 'NOT_ATTEMPTED'))), ',') AS unattempted,
CAST(sum(CASE WHEN mark_status IN ('MARKED', 'FLAGGED') THEN CAST(floor(marks * 100 + 0.5) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS authoritative_total, CAST(sum(CAST(floor(marks * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS all_marks
FROM marks GROUP BY 1""")  # fmt: skip
def marks_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("mark_status"), cents(F.col("marks"))
    out = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(
        F.count_if(s.isin(*ops.COUNTED)).alias("evaluated"), F.count_if(s == "NOT_ATTEMPTED").alias("not_attempted"), F.count_if(s == "FLAGGED").alias("flagged"),
        F.collect_set(F.when(s == "NOT_ATTEMPTED", F.col("question_number"))).alias("u"), F.sum(F.when(s.isin(*ops.COUNTED), c).otherwise(0)).alias("a"), F.sum(c).alias("t"),
    )
    unattempted = F.when(F.size("u") > 0, F.array_join(F.transform(F.sort_array("u"), lambda x: x.cast("string")), ","))
    return out.select("evaluation_id", "evaluated", "not_attempted", "flagged", unattempted.alias("unattempted"), (F.col("a") / 100.0).alias("authoritative_total"), (F.col("t") / 100.0).alias("all_marks"))


_PERCENT = """, s AS (SELECT evaluation_id, sum(CASE WHEN mark_status IN ('MARKED', 'FLAGGED') THEN CAST(floor(least(marks, max_marks) * 100 + 0.5) AS BIGINT) ELSE 0 END) AS c, sum(max_marks) AS m FROM marks JOIN questions USING (question_id) GROUP BY 1),
p AS (SELECT evaluation_id, floor(CASE WHEN m <> 0 THEN c::DOUBLE / m ELSE 0 END * 100 + 0.5) / 100 AS percent FROM s),
g AS (SELECT evaluation_id, percent, CASE WHEN percent >= 90 THEN 'A+' WHEN percent >= 80 THEN 'A' WHEN percent >= 70 THEN 'B+' WHEN percent >= 60 THEN 'B' WHEN percent >= 50 THEN 'C' WHEN percent >= 40 THEN 'P' ELSE 'F' END AS grade,
CASE WHEN percent >= 90 THEN 10 WHEN percent >= 80 THEN 9 WHEN percent >= 70 THEN 8 WHEN percent >= 60 THEN 7 WHEN percent >= 50 THEN 6 WHEN percent >= 40 THEN 4 ELSE 0 END AS point,
CASE WHEN percent >= 80 THEN 'FIRST_CLASS_DISTINCTION' WHEN percent >= 70 THEN 'FIRST_CLASS' WHEN percent >= 60 THEN 'HIGHER_SECOND_CLASS' WHEN percent >= 50 THEN 'SECOND_CLASS' WHEN percent >= 40 THEN 'PASS' ELSE 'FAIL' END AS classification FROM p)
"""


def _percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.marks(spark, sf_dir).join(domain.questions(spark, sf_dir).select("question_id", "max_marks"), "question_id")
    capped = cents(F.least("marks", F.col("max_marks").cast("double")))
    sums = rows.groupBy("evaluation_id").agg(F.sum(F.when(F.col("mark_status").isin(*ops.COUNTED), capped).otherwise(0)).alias("c"), F.sum("max_marks").alias("m"))
    return sums.select("evaluation_id", js_round(ratio(F.col("c"), F.col("m")), 2).alias("percent"))


@query(D + _PERCENT + "SELECT evaluation_id, percent, grade, point, classification FROM g")
def grade_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, point, kind = ops.grade(F.col("percent"))
    return _percent(spark, sf_dir).select("evaluation_id", "percent", name.alias("grade"), point.alias("point"), kind.alias("classification"))


@query(D + _PERCENT + "SELECT grade, count(*) AS n, min(percent) AS lowest, max(percent) AS highest FROM g GROUP BY grade")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_classification(spark, sf_dir).groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.min("percent").alias("lowest"), F.max("percent").alias("highest"))


# The order and the codes of the checks before a result is final.
_GATE = _FAIL + f""", s AS (SELECT evaluation_id, count(*) AS n, sum({_C.format('amount')}) AS a, sum({_C.format('marks')}) AS c, sum(max_marks) * 100 AS m, count(code) AS failed, count(DISTINCT question_number) AS d, max(question_number) AS top, count(*) FILTER (NOT reviewed) AS unreviewed,
  count(*) FILTER (reviewed AND mark_status = 'NOT_STARTED') AS undecided FROM f GROUP BY 1),
g AS (SELECT e.*, {_BOOK} AS book, s.* EXCLUDE (evaluation_id) FROM evaluations e LEFT JOIN s USING (evaluation_id))
"""
_FINAL = """CASE WHEN status <> 'APPROVED' THEN 'INVALID_EVALUATION_STATUS' WHEN book <> 'APPROVED' THEN 'INVALID_ANSWER_BOOK_STATUS' WHEN n IS NULL THEN 'NO_QUESTION_MARKS' WHEN failed > 0 THEN 'INVALID_MARKS' WHEN d < top THEN 'MISSING_QUESTIONS'
WHEN unreviewed > 0 THEN 'UNREVIEWED' WHEN undecided > 0 THEN 'QUESTION_DECISION_REQUIRED' WHEN abs(a - CAST(floor(total_marks * 100 + 0.5) AS BIGINT)) > 0 THEN 'TOTAL_MARKS_MISMATCH' WHEN coalesce(m, 0) <= 0 THEN 'INVALID_EXAM_MAXIMUM_MARKS' WHEN c > m THEN 'TOTAL_EXCEEDS_EXAM_MAXIMUM' ELSE 'OK' END"""


def gate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation with the sums and failures of its marks, and its book's state; the amounts stand in for the recorded total's parts."""
    rows = ops.mark_failures(domain.marks(spark, sf_dir), domain.questions(spark, sf_dir))
    sums = rows.groupBy("evaluation_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("amount"))).alias("a"), F.sum(cents(F.col("marks"))).alias("c"), (F.sum("max_marks") * 100).alias("m"), F.count("code").alias("failed"),
        F.count_distinct("question_number").alias("d"), F.max("question_number").alias("top"), F.count_if(~F.col("reviewed")).alias("unreviewed"), F.count_if(F.col("reviewed") & (F.col("mark_status") == "NOT_STARTED")).alias("undecided"),
    )
    return domain.evaluations(spark, sf_dir).withColumn("book", book_status()).join(sums, "evaluation_id", "left")


def submission_problems() -> tuple:
    """The checks of a submission, in order: marks, missing, not reviewed, reviewed but undecided."""
    return ((F.col("failed") > 0, "INVALID_MARKS"), (F.col("d") < F.col("top"), "MISSING_QUESTIONS"), (F.col("unreviewed") > 0, "UNREVIEWED"), (F.col("undecided") > 0, "QUESTION_DECISION_REQUIRED"))


def final_outcome():
    mismatch = F.abs(F.col("a") - cents(F.col("total_marks"))) > 0
    outcome = first_failure(
        (F.col("status") != "APPROVED", "INVALID_EVALUATION_STATUS"), (F.col("book") != "APPROVED", "INVALID_ANSWER_BOOK_STATUS"), (F.col("n").isNull(), "NO_QUESTION_MARKS"), *submission_problems(),
        (mismatch, "TOTAL_MARKS_MISMATCH"), (F.coalesce("m", F.lit(0)) <= 0, "INVALID_EXAM_MAXIMUM_MARKS"), (F.col("c") > F.col("m"), "TOTAL_EXCEEDS_EXAM_MAXIMUM"),
    )
    return F.coalesce(outcome, F.lit("OK"))


@query(D + _GATE + f"SELECT evaluation_id, {_FINAL} AS outcome FROM g")
def final_result_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_facts(spark, sf_dir).select("evaluation_id", final_outcome().alias("outcome"))


@query(D + _GATE + """SELECT evaluation_id, CASE WHEN failed > 0 THEN 'INVALID_MARKS' WHEN d < top THEN 'MISSING_QUESTIONS' WHEN unreviewed > 0 THEN 'UNREVIEWED' WHEN undecided > 0 THEN 'QUESTION_DECISION_REQUIRED'
WHEN CASE WHEN m > 0 THEN m ELSE 10000 END > 0 AND c > CASE WHEN m > 0 THEN m ELSE 10000 END THEN 'TOTAL_EXCEEDS_EXAM_MAXIMUM' ELSE 'OK' END AS outcome, c / 100.0::DOUBLE AS computed_total, CASE WHEN m > 0 THEN m ELSE 10000 END / 100.0::DOUBLE AS maximum FROM g WHERE n IS NOT NULL""")  # fmt: skip
def submission_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission against the sum of the questions' maxima, or the exam's (100 here) where that is not positive."""
    cap = F.when(F.col("m") > 0, F.col("m")).otherwise(10000)
    outcome = first_failure(*submission_problems(), ((cap > 0) & (F.col("c") > cap), "TOTAL_EXCEEDS_EXAM_MAXIMUM"))
    return gate_facts(spark, sf_dir).where("n is not null").select("evaluation_id", F.coalesce(outcome, F.lit("OK")).alias("outcome"), (F.col("c") / 100.0).alias("computed_total"), (cap / 100.0).alias("maximum"))


@query(D + _GATE + """SELECT evaluation_id, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'No question has marks.' END, CASE WHEN unreviewed > 0 THEN unreviewed || ' questions are not reviewed.' END, CASE WHEN c > m THEN 'The total is above the maximum.' END,
CASE WHEN quality_status = 'RESCAN_REQUIRED' THEN 'Pages wait for a new scan.' END], lambda x: x IS NOT NULL), ' ') AS problems FROM g""")  # fmt: skip
def client_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason in words; valid where there is none."""
    says = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "No question has marks."), F.when(F.col("unreviewed") > 0, F.concat(F.col("unreviewed").cast("string"), F.lit(" questions are not reviewed."))),
        F.when(F.col("c") > F.col("m"), "The total is above the maximum."), F.when(F.col("quality_status") == "RESCAN_REQUIRED", "Pages wait for a new scan."),
    ))
    return gate_facts(spark, sf_dir).select("evaluation_id", F.array_join(says, " ").alias("problems"))


_STATE = "CASE event_type WHEN 'signup' THEN 'READY' WHEN 'view' THEN 'ASSIGNED' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'SUBMITTED' ELSE 'RETURNED' END"


def book_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of each book (a user's events, in time order) as steps."""
    e = F.col("event_type")
    state = F.when(e == "signup", "READY").when(e == "view", "ASSIGNED").when(e == "click", "IN_PROGRESS").when(e == "purchase", "SUBMITTED").otherwise("RETURNED")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return domain.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", state.alias("after")).withColumn("before", F.lag("after").over(order))


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, to in ops.BOOK_NEXT.items() for b in (a, *to))


@query(f"""WITH s AS (SELECT event_id, user_id, {_STATE} AS after, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), allowed(a, b) AS (VALUES {_ALLOWED})
SELECT event_id, user_id, before, after FROM s WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = before AND b = after)""")  # fmt: skip
def status_transitions_illegal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.illegal_steps(book_steps(spark, sf_dir), ops.BOOK_NEXT).select("event_id", "user_id", "before", "after")


_PROCESSING = "CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'OCR_PROCESSING' WHEN 'purchase' THEN 'FINALIZED' ELSE 'ERROR' END"
_ALLOWED_PROCESSING = ", ".join(f"('{a}', '{b}')" for a, to in ops.PROCESSING_NEXT.items() for b in (a, *to))


@query(f"""WITH s AS (SELECT event_id, user_id, {_PROCESSING} AS after, lag({_PROCESSING}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), allowed(a, b) AS (VALUES {_ALLOWED_PROCESSING})
SELECT event_id, user_id, before, after FROM s WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = before AND b = after)""")  # fmt: skip
def processing_transitions_illegal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    state = F.when(e == "signup", "RECEIVED").when(e == "view", "PROCESSING").when(e == "click", "OCR_PROCESSING").when(e == "purchase", "FINALIZED").otherwise("ERROR")
    rows = domain.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", state.alias("after"))
    steps = rows.withColumn("before", F.lag("after").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return ops.illegal_steps(steps, ops.PROCESSING_NEXT).select("event_id", "user_id", "before", "after")


@query(f"SELECT user_id, {_STATE} AS status, ts AS since, n AS n_events FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def status_fold_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "after"))
    return book_steps(spark, sf_dir).groupBy("user_id").agg(last.alias("l"), F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("l.after").alias("status"), F.col("l.ts").alias("since"), "n_events")


@query(D + """, s AS (SELECT evaluation_id, count(*) AS n, min(question_number) AS low, max(question_number) AS top, count(DISTINCT question_number) AS d FROM marks GROUP BY 1)
SELECT evaluation_id, array_to_string(list_filter([CASE WHEN d < n THEN 'DUPLICATE' END, CASE WHEN low <> 1 THEN 'FIRST_MISSING' END, CASE WHEN d <> top - low + 1 THEN 'GAP' END], lambda x: x IS NOT NULL), ',') AS problems
FROM s WHERE d < n OR low <> 1 OR d <> top - low + 1""")  # fmt: skip
def page_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("n"), F.min("question_number").alias("low"), F.max("question_number").alias("top"), F.count_distinct("question_number").alias("d"))
    codes = every_failure((F.col("d") < F.col("n"), "DUPLICATE"), (F.col("low") != 1, "FIRST_MISSING"), (F.col("d") != F.col("top") - F.col("low") + 1, "GAP"))
    return s.select("evaluation_id", F.array_join(codes, ",").alias("problems")).where("problems <> ''")
