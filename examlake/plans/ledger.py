"""Whole records for readers outside: one shape for the issues of all integrity rules, and the results ledger as it is exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import falsy
from ..operators import rules as operators
from ..operators.scoring import plain_number
from ..sources import domain
from ..sources.domain import SQL as D
from . import rules, scopes
from .registry import registry

QUERIES, ORACLE, query = registry()

# What each rule is called.
RULE_NAMES = {
    "duplicate-eval": "Duplicate Evaluation Detected",
    "exceeds-max": "Marks Above Maximum Limit",
    "arithmetic": "Arithmetic Sum Discrepancy",
    "negative": "Negative Mark Awarded",
    "over-rubric": "Question Mark Exceeds Rubric Limit",
    "not-attempted-with-marks": "Unattempted Question Awarded Marks",
    "incomplete": "Unchecked Questions in Submitted Script",
    "rescan-breach": "Rescan Required Pending Evaluation",
    "custody": "Custody State Desynchronization",
    "missing-pages": "Invalid Page Count",
    "defective-page": "Scanned Page Ingestion Defect",
}
#: Rules that ``integrity_records`` tells of; the others come from ``integrity_all``.
_RECORDED = ("duplicate-eval", "exceeds-max", "missing-pages", "defective-page")
_TOLD = tuple(r for r in RULE_NAMES if r not in _RECORDED)
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RULE_NAMES.items())
_RULE = "CASE " + " ".join(f"WHEN issue_id LIKE '{r}-%' THEN '{r}'" for r in _RECORDED) + " END"


def _stamp(at: Column) -> Column:
    return F.date_format(at.cast("timestamp"), _ISO)


@query(D + f""", told AS (SELECT issue_id, rule, severity, evaluation_id, NULL::VARCHAR AS examiner, detail AS description FROM ({rules.ORACLE["integrity_all"]}) WHERE rule IN ({", ".join(f"'{r}'" for r in _TOLD)})
UNION ALL SELECT issue_id, {_RULE}, severity, evaluation_id, examiner, description FROM ({scopes.ORACLE["integrity_records"]}))
SELECT issue_id, CASE rule {_NAMES} END AS rule_name, severity, t.evaluation_id, 'B' || t.evaluation_id AS book_code, coalesce(exam, '—') AS exam_code, coalesce(t.examiner, examiner_name, 'Unknown') AS examiner, description, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS detected_at
FROM told t LEFT JOIN evaluations e ON e.evaluation_id = t.evaluation_id LEFT JOIN examiners x ON x.examiner_id = e.examiner_id""")  # fmt: skip
def integrity_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of all eleven rules in one shape: id, rule, severity, book, exam, examiner, description and time.

    Issues are made by their own rules and only named here. What they need of the evaluation and its examiner is joined
    to the marks and sums that they come from, as issues are more and wider than those; only the few of a whole
    evaluation's state are joined afterwards.
    """
    ev, people = domain.evaluations(spark, sf_dir), domain.examiners(spark, sf_dir)
    about = ev.select("evaluation_id", "examiner_id", "started_at").join(people.select("examiner_id", "examiner_name", "exam"), "examiner_id", "left").select(
        "evaluation_id", F.col("examiner_name").alias("its_examiner"), F.col("exam").alias("its_exam"), F.col("started_at").alias("its_start")
    )
    of_marks = operators.issues_of_marks(ev, domain.marks(spark, sf_dir), domain.questions(spark, sf_dir), _TOLD, about)
    of_states = operators.joined_before(operators.all_issues(operators.rescan_breach(ev), operators.custody(ev, rules.book_status())), about)
    told = of_marks.unionByName(of_states).withColumns({"who": F.lit(None).cast("string"), "description": F.col("detail")}).drop("detail")
    rule = F.coalesce(*[F.when(F.startswith("issue_id", F.lit(f"{r}-")), r) for r in _RECORDED])
    recorded = scopes.records(spark, sf_dir, about).select("issue_id", rule.alias("rule"), "severity", "evaluation_id", F.col("examiner").alias("who"), "description", "its_examiner", "its_exam", "its_start")
    names = F.create_map(*[F.lit(x) for kv in RULE_NAMES.items() for x in kv])
    return told.unionByName(recorded).select(
        "issue_id", names[F.col("rule")].alias("rule_name"), "severity", "evaluation_id", F.concat(F.lit("B"), F.col("evaluation_id").cast("string")).alias("book_code"), F.coalesce("its_exam", F.lit("—")).alias("exam_code"),
        F.coalesce("who", "its_examiner", F.lit("Unknown")).alias("examiner"), "description", _stamp(F.col("its_start")).alias("detected_at"),
    )


#: Columns of the ledger, in the order in which they are exported.
COLUMNS = (
    "student_code", "script_code", "subject_code", "examination_title", "accredited_examiner", "marks_awarded", "maximum_marks", "percentage", "grade", "grade_points", "classification", "status",
    "finalized_at", "finalized_by", "published_at", "published_by", "withheld_reason",
)
_NUM = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"


@query(D + f""", top AS (SELECT evaluation_id, sum(max_marks)::DOUBLE AS m FROM marks JOIN questions USING (question_id) GROUP BY 1), g AS (SELECT * FROM ({rules.ORACLE["grade_classification"]})),
r AS (SELECT *, round(total_marks, 2) AS total, started_at + INTERVAL 1 DAY AS closed FROM evaluations LEFT JOIN examiners USING (examiner_id) LEFT JOIN top USING (evaluation_id) LEFT JOIN g USING (evaluation_id) WHERE status = 'APPROVED')
SELECT 'S' || evaluation_id AS student_code, 'B' || evaluation_id AS script_code, coalesce(nullif(exam, ''), '—') AS subject_code, coalesce('Examination ' || nullif(exam, ''), '—') AS examination_title, coalesce(nullif(examiner_name, ''), '—') AS accredited_examiner,
  {_NUM.format("total")} AS marks_awarded, {_NUM.format("m")} AS maximum_marks, {_NUM.format("percent")} || '%' AS percentage, coalesce(grade, '—') AS grade, coalesce({_NUM.format("point::DOUBLE")}, '—') AS grade_points, coalesce(classification, '—') AS classification,
  CASE quality_status WHEN 'PASSED' THEN 'PUBLISHED' ELSE 'WITHHELD' END AS status, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS finalized_at, 'Examination Board' AS finalized_by,
  CASE quality_status WHEN 'PASSED' THEN strftime(closed, '%Y-%m-%dT%H:%M:%SZ') ELSE '—' END AS published_at, '—' AS published_by, CASE quality_status WHEN 'PASSED' THEN '—' ELSE 'Page quality: ' || quality_status END AS withheld_reason FROM r""")  # fmt: skip
def results_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certified results with all columns of the export, defaults filled in; ``write_csv`` writes them.

    Codes, titles and times of publication follow from the evaluation, as the tables have none.
    """
    ev = domain.evaluations(spark, sf_dir).where("status = 'APPROVED'").join(domain.examiners(spark, sf_dir).select("examiner_id", "examiner_name", "exam"), "examiner_id", "left")
    top = domain.marks(spark, sf_dir).join(domain.questions(spark, sf_dir).select("question_id", "max_marks"), "question_id").groupBy("evaluation_id").agg(F.sum("max_marks").cast("double").alias("m"))
    grades = rules.QUERIES["grade_classification"](spark, sf_dir).select("evaluation_id", "percent", F.col("grade").alias("g"), "point", F.col("classification").alias("k"))
    rows = ev.join(top, "evaluation_id", "left").join(grades, "evaluation_id", "left")
    code = lambda letter: F.concat(F.lit(letter), F.col("evaluation_id").cast("string"))
    exam, passed = falsy(F.col("exam"), "—"), F.col("quality_status") == "PASSED"
    values = (
        code("S"), code("B"), exam, F.when(exam != "—", F.concat(F.lit("Examination "), exam)).otherwise("—"), falsy(F.col("examiner_name"), "—"), plain_number(F.round("total_marks", 2)), plain_number(F.col("m")),
        F.concat(plain_number(F.col("percent")), F.lit("%")), F.coalesce("g", F.lit("—")), F.coalesce(plain_number(F.col("point").cast("double")), F.lit("—")), F.coalesce("k", F.lit("—")), F.when(passed, "PUBLISHED").otherwise("WITHHELD"),
        _stamp(F.col("started_at")), F.lit("Examination Board"), F.when(passed, _stamp(F.col("started_at") + F.expr("INTERVAL 1 DAY"))).otherwise("—"), F.lit("—"), F.when(passed, "—").otherwise(F.concat(F.lit("Page quality: "), F.col("quality_status"))),
    )
    return rows.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])
