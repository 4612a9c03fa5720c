"""Queries of dashboards, queues, rosters and lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import cents, falsy, js_round, ratio
from ..operators import dashboards as ops
from ..sources import domain
from ..sources.domain import SQL as D
from .registry import registry

QUERIES, ORACLE, query = registry()


@query(D + """, e AS (
  SELECT v.examiner_id, v.status, v.total_marks, m.flags, date_diff('minute', v.started_at, m.submitted_at) AS minutes
  FROM evaluations v LEFT JOIN (SELECT evaluation_id, count(*) FILTER (mark_status = 'FLAGGED') AS flags, max(marked_at) AS submitted_at FROM marks GROUP BY 1) m USING (evaluation_id)),
s AS (SELECT examiner_id, count(*) AS assigned, count(*) FILTER (status IN ('SUBMITTED', 'APPROVED')) AS completed, count(*) FILTER (status = 'RETURNED') AS returned,
        sum(CASE WHEN status IN ('SUBMITTED', 'APPROVED') THEN coalesce(flags, 0) ELSE 0 END) + count(*) FILTER (status = 'RETURNED') AS flags,
        sum(CASE WHEN status IN ('SUBMITTED', 'APPROVED') THEN CAST(floor(total_marks * 100 + 0.5) AS BIGINT) END) AS c,
        sum(CASE WHEN status IN ('SUBMITTED', 'APPROVED') AND minutes > 0 THEN minutes END) AS mins, count(*) FILTER (status IN ('SUBMITTED', 'APPROVED') AND minutes > 0) AS worked FROM e GROUP BY 1)
SELECT examiner_id, examiner_name, coalesce(assigned, 0)::BIGINT AS assigned, coalesce(completed, 0)::BIGINT AS completed, coalesce(returned, 0)::BIGINT AS returned, coalesce(flags, 0)::BIGINT AS flags,
       CASE WHEN completed > 0 THEN floor(c::DOUBLE / (completed * 100.0::DOUBLE) * 10 + 0.5) / 10 ELSE 0 END::DOUBLE AS average_marks,
       CASE WHEN worked > 0 THEN floor(mins::DOUBLE / worked + 0.5) ELSE 0 END::DOUBLE AS average_minutes
FROM examiners LEFT JOIN s USING (examiner_id)""")  # fmt: skip
def examiner_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.examiner_analytics(domain.examiners(spark, sf_dir), domain.evaluations(spark, sf_dir), domain.marks(spark, sf_dir))


@query(D + """SELECT institution_group, institution, count(*) AS assigned, count(*) FILTER (status IN ('SUBMITTED', 'APPROVED')) AS completed
FROM evaluations JOIN examiners USING (examiner_id) LEFT JOIN institutions USING (institution_id) GROUP BY ROLLUP (institution_group, institution)""")  # fmt: skip
def roster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = domain.examiners(spark, sf_dir).join(F.broadcast(domain.institutions(spark, sf_dir)), "institution_id", "left")  # one row for each nation
    rows = domain.evaluations(spark, sf_dir).select("examiner_id", "status").join(people.select("examiner_id", "institution_group", "institution"), "examiner_id")
    return rows.rollup("institution_group", "institution").agg(F.count(F.lit(1)).alias("assigned"), F.count_if(F.col("status").isin(*ops.DONE)).alias("completed"))


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("READY", "ASSIGNED", "IN_PROGRESS", "SUBMITTED", "UNDER_REVIEW", "APPROVED", "RETURNED", "FINALIZED"))


@query(D + f"SELECT {_COUNTS}, count(*) AS total FROM evaluations")
def dashboard_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.status_counts(domain.evaluations(spark, sf_dir), "status", ("READY", "ASSIGNED", "IN_PROGRESS", "SUBMITTED", "UNDER_REVIEW", "APPROVED", "RETURNED", "FINALIZED"))


@query(D + "SELECT count(*) FILTER (status = 'SUBMITTED') AS submitted, count(*) FILTER (status = 'UNDER_REVIEW') AS under_review, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'RETURNED') AS returned, count(*) AS total FROM evaluations WHERE status IN ('SUBMITTED', 'UNDER_REVIEW', 'APPROVED', 'RETURNED')")
def moderation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ("SUBMITTED", "UNDER_REVIEW", "APPROVED", "RETURNED")
    return ops.status_counts(domain.evaluations(spark, sf_dir).where(F.col("status").isin(*states)), "status", states)


@query(D + """SELECT count(*) AS scanned, count(*) FILTER (quality_status = 'PASSED') AS quality_passed, count(*) FILTER (quality_status = 'RESCAN_REQUIRED') AS rescan_required,
count(*) FILTER (marked) AS ocr_done, count(*) FILTER (status = 'APPROVED' AND quality_status = 'PASSED') AS finalized,
count(*) FILTER (status IS NOT NULL) AS assigned, count(*) FILTER (status IN ('SUBMITTED', 'APPROVED')) AS evaluated, count(*) FILTER (status = 'APPROVED') AS approved
FROM (SELECT *, EXISTS (SELECT 1 FROM marks m WHERE m.evaluation_id = e.evaluation_id) AS marked FROM evaluations e)""")  # fmt: skip
def pipeline_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda c, *v: F.count_if(F.col(c).isin(*v))
    marked = domain.marks(spark, sf_dir).select("evaluation_id").distinct().withColumn("marked", F.lit(True))
    return domain.evaluations(spark, sf_dir).join(marked, "evaluation_id", "left").agg(
        F.count("marked").alias("ocr_done"), F.count_if((F.col("status") == "APPROVED") & (F.col("quality_status") == "PASSED")).alias("finalized"),
        F.count(F.lit(1)).alias("scanned"), is_("quality_status", "PASSED").alias("quality_passed"), is_("quality_status", "RESCAN_REQUIRED").alias("rescan_required"),
        F.count("status").alias("assigned"), is_("status", *ops.DONE).alias("evaluated"), is_("status", "APPROVED").alias("approved"),
    )


@query(D + """SELECT exam, count(*) FILTER (status IN ('SUBMITTED', 'APPROVED')) AS evaluated, count(*) FILTER (status = 'SUBMITTED') AS pending, count(*) FILTER (status = 'APPROVED') AS approved,
count(*) FILTER (status = 'APPROVED' AND quality_status = 'RESCAN_REQUIRED') AS withheld, count(*) FILTER (status = 'APPROVED' AND quality_status <> 'RESCAN_REQUIRED') AS publishable
FROM evaluations JOIN examiners USING (examiner_id) GROUP BY exam""")  # fmt: skip
def result_ledger_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id")
    approved, rescan = F.col("status") == "APPROVED", F.col("quality_status") == "RESCAN_REQUIRED"
    return rows.groupBy("exam").agg(
        F.count_if(F.col("status").isin(*ops.DONE)).alias("evaluated"), F.count_if(F.col("status") == "SUBMITTED").alias("pending"), F.count_if(approved).alias("approved"),
        F.count_if(approved & rescan).alias("withheld"), F.count_if(approved & ~rescan).alias("publishable"),
    )


@query("SELECT 'EXAMINER' AS role, count(*) AS n FROM customer UNION ALL SELECT 'MODERATOR', count(*) FROM supplier")
def role_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, role: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(role).alias("role"), "n")
    return count(domain.examiners(spark, sf_dir), "EXAMINER").unionByName(count(domain.moderators(spark, sf_dir), "MODERATOR"))


@query(D + """, l AS (SELECT examiner_id, count(*) FILTER (status IN ('ASSIGNED', 'IN_PROGRESS')) AS active FROM evaluations GROUP BY 1)
SELECT examiner_id, coalesce(active, 0)::BIGINT AS active_load, CASE WHEN coalesce(active, 0) >= 5 THEN 'AT_CAPACITY' WHEN coalesce(active, 0) >= 2 THEN 'MODERATE' ELSE 'AVAILABLE' END AS band
FROM examiners LEFT JOIN l USING (examiner_id)""")  # fmt: skip
def examiner_workload_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = domain.evaluations(spark, sf_dir).groupBy("examiner_id").agg(F.count_if(F.col("status").isin("ASSIGNED", "IN_PROGRESS")).alias("active"))
    active = F.coalesce("active", F.lit(0)).cast("bigint")
    return domain.examiners(spark, sf_dir).join(load, "examiner_id", "left").select("examiner_id", active.alias("active_load"), ops.capacity_band(active).alias("band"))


@query(D + "SELECT examiner_id, count(*) AS assigned, count(*) FILTER (status = 'IN_PROGRESS') AS in_progress, count(*) FILTER (status IN ('SUBMITTED', 'UNDER_REVIEW', 'APPROVED')) AS submitted, count(*) FILTER (status = 'RETURNED') AS returned FROM evaluations GROUP BY 1")
def examiner_docket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return domain.evaluations(spark, sf_dir).groupBy("examiner_id").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if(s == "IN_PROGRESS").alias("in_progress"), F.count_if(s.isin("SUBMITTED", "UNDER_REVIEW", "APPROVED")).alias("submitted"), F.count_if(s == "RETURNED").alias("returned")
    )


@query(D + """SELECT exam, count(*) AS total, count(*) FILTER (status IN ('SUBMITTED', 'APPROVED')) AS evaluated,
CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (status IN ('SUBMITTED', 'APPROVED')) * 100.0::DOUBLE / count(*) + 0.5) ELSE 0 END::DOUBLE AS percent
FROM evaluations JOIN examiners USING (examiner_id) GROUP BY exam""")  # fmt: skip
def exam_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).select("examiner_id", "status").join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id")
    by = rows.groupBy("exam").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*ops.DONE)).alias("evaluated"))
    return by.withColumn("percent", js_round(ratio(F.col("evaluated") * 100.0, F.col("total"))))


@query(D + """SELECT examiner_id, evaluation_id AS last_evaluation, status AS last_status, started_at AS last_seen FROM (
SELECT *, row_number() OVER (PARTITION BY examiner_id ORDER BY started_at DESC, evaluation_id DESC) AS r FROM evaluations) WHERE r = 1""")  # fmt: skip
def examiner_last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("started_at", "evaluation_id", "status"))  # one pass, combined on the map side
    return domain.evaluations(spark, sf_dir).groupBy("examiner_id").agg(last.alias("l")).select("examiner_id", F.col("l.evaluation_id").alias("last_evaluation"), F.col("l.status").alias("last_status"), F.col("l.started_at").alias("last_seen"))


@query(D + """SELECT v.evaluation_id, e.examiner_name, v.status, floor(v.total_marks * 100 + 0.5)::BIGINT AS total_cents, coalesce(m.c, 0)::BIGINT AS marks_cents,
(abs(coalesce(m.c, 0) - floor(v.total_marks * 100 + 0.5)) > 1 OR v.quality_status = 'RESCAN_REQUIRED' OR coalesce(floor(v.total_marks * 100 + 0.5) > m.mx * 100, false)) AS anomaly
FROM evaluations v LEFT JOIN examiners e USING (examiner_id) LEFT JOIN (SELECT evaluation_id, sum(floor(amount * 100 + 0.5)::BIGINT) AS c, sum(max_marks) AS mx FROM marks LEFT JOIN questions USING (question_id) GROUP BY 1) m USING (evaluation_id)
WHERE v.status IN ('SUBMITTED', 'UNDER_REVIEW')""")  # fmt: skip
def moderation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = domain.evaluations(spark, sf_dir).where(F.col("status").isin("SUBMITTED", "UNDER_REVIEW"))
    rows = domain.marks(spark, sf_dir).join(domain.questions(spark, sf_dir).select("question_id", "max_marks"), "question_id", "left")
    sums = rows.groupBy("evaluation_id").agg(F.sum(cents(F.col("amount"))).alias("c"), F.sum("max_marks").alias("mx"))
    total, c = cents(F.col("total_marks")), F.coalesce("c", F.lit(0)).cast("bigint")
    joined = queue.join(sums, "evaluation_id", "left").join(domain.examiners(spark, sf_dir).select("examiner_id", "examiner_name"), "examiner_id", "left")
    return joined.select("evaluation_id", "examiner_name", "status", total.alias("total_cents"), c.alias("marks_cents"), ((F.abs(c - total) > 1) | (F.col("quality_status") == "RESCAN_REQUIRED") | F.coalesce(total > F.col("mx") * 100, F.lit(False))).alias("anomaly"))


@query(D + "SELECT evaluation_id, status, examiner_name, exam, institution, institution_group FROM evaluations LEFT JOIN examiners USING (examiner_id) LEFT JOIN institutions USING (institution_id)")
def evaluation_two_level_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = domain.evaluations(spark, sf_dir).join(domain.examiners(spark, sf_dir), "examiner_id", "left").join(F.broadcast(domain.institutions(spark, sf_dir)), "institution_id", "left")
    return joined.select("evaluation_id", "status", "examiner_name", "exam", "institution", "institution_group")


@query(D + """SELECT m.evaluation_id, m.question_number, m.marks, q.max_marks, v.status, e.examiner_name, mo.moderator_name, i.institution AS examiner_institution, j.institution AS moderator_institution
FROM marks m LEFT JOIN evaluations v USING (evaluation_id) LEFT JOIN questions q USING (question_id) LEFT JOIN examiners e ON e.examiner_id = v.examiner_id LEFT JOIN moderators mo USING (moderator_id)
LEFT JOIN institutions i ON i.institution_id = e.institution_id LEFT JOIN institutions j ON j.institution_id = mo.institution_id""")  # fmt: skip
def result_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = domain.institutions(spark, sf_dir).select("institution_id", "institution")  # one row for each nation
    people = domain.examiners(spark, sf_dir).join(F.broadcast(where.withColumnRenamed("institution", "examiner_institution")), "institution_id", "left").select("examiner_id", "examiner_name", "examiner_institution")
    others = domain.moderators(spark, sf_dir).join(F.broadcast(where.withColumnRenamed("institution", "moderator_institution")), "institution_id", "left").select("moderator_id", "moderator_name", "moderator_institution")
    joined = domain.marks(spark, sf_dir).join(domain.evaluations(spark, sf_dir), "evaluation_id", "left").join(domain.questions(spark, sf_dir), "question_id", "left").join(people, "examiner_id", "left").join(others, "moderator_id", "left")
    return joined.select("evaluation_id", "question_number", "marks", "max_marks", "status", "examiner_name", "moderator_name", "examiner_institution", "moderator_institution")


@query("SELECT event_id, event_type, user_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def audit_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "event_type", "user_id", "ts")
    return ops.page(rows, [F.col("ts").desc(), F.col("event_id").desc()], 2, 50)


@query("SELECT event_type, count(*) AS total, ceil(count(*) / 50)::BIGINT AS total_pages FROM events GROUP BY 1")
def audit_pagination_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 50).alias("total_pages"))


@query(D + "SELECT evaluation_id, question_number, marks FROM marks WHERE evaluation_id IN (SELECT evaluation_id FROM evaluations WHERE status = 'APPROVED')")
def semi_approved_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = domain.evaluations(spark, sf_dir).where("status = 'APPROVED'").select("evaluation_id")
    return domain.marks(spark, sf_dir).select("evaluation_id", "question_number", "marks").join(approved, "evaluation_id", "left_semi")


@query(D + "SELECT evaluation_id, examiner_id, status FROM evaluations v WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.evaluation_id = v.evaluation_id)")
def anti_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.evaluations(spark, sf_dir).select("evaluation_id", "examiner_id", "status").join(domain.marks(spark, sf_dir), "evaluation_id", "left_anti")


@query(D + """SELECT evaluation_id, question_number, other_marks, abs(first_marks - other_marks) AS gap, abs(first_marks - other_marks) > 5 AS highlight FROM (
SELECT evaluation_id, question_number, marks AS other_marks, first_value(marks) OVER w AS first_marks, row_number() OVER w AS r FROM marks
WINDOW w AS (PARTITION BY evaluation_id, question_number ORDER BY question_id, moderator_id, marks, amount)) WHERE r = 2""")  # fmt: skip
def self_second_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("evaluation_id", "question_number").orderBy("question_id", "moderator_id", "marks", "amount")
    second = domain.marks(spark, sf_dir).withColumns({"first_marks": F.first("marks").over(w), "r": F.row_number().over(w)}).where("r = 2")
    gap = F.abs(F.col("first_marks") - F.col("marks"))
    return second.select("evaluation_id", "question_number", F.col("marks").alias("other_marks"), gap.alias("gap"), (gap > 5).alias("highlight"))


@query(D + """SELECT e.evaluation_id, n.question_number FROM (SELECT evaluation_id, max(question_number) AS top FROM marks GROUP BY 1) e, unnest(range(1, e.top + 1)) n(question_number)
WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.evaluation_id = e.evaluation_id AND m.question_number = n.question_number AND m.mark_status <> 'NOT_STARTED')""")  # fmt: skip
def missing_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(F.collect_set(F.when(F.col("mark_status") != "NOT_STARTED", F.col("question_number"))).alias("seen"), F.max("question_number").alias("top"))
    return numbers.select("evaluation_id", F.explode(F.array_except(F.sequence(F.lit(1), "top"), "seen")).alias("number")).select("evaluation_id", F.col("number").cast("bigint").alias("question_number"))


@query(D + """SELECT evaluation_id, examiner_name, exam, paper_set FROM evaluations LEFT JOIN examiners USING (examiner_id)
WHERE lower(coalesce(examiner_name, '')) LIKE '%00001%' OR lower(coalesce(exam, '')) LIKE '%00001%' OR lower(coalesce(paper_set, '')) LIKE '%00001%'""")  # fmt: skip
def issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).join(domain.examiners(spark, sf_dir), "examiner_id", "left").select("evaluation_id", "examiner_name", "exam", "paper_set")
    return ops.search(rows, ["examiner_name", "exam", "paper_set"], "00001")


@query(D + "SELECT DISTINCT exam, year(started_at)::BIGINT AS session_year FROM evaluations JOIN examiners USING (examiner_id)")
def academic_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id")
    return rows.select("exam", F.year("started_at").cast("bigint").alias("session_year")).distinct()


@query(D + """SELECT evaluation_id, coalesce(nullif(examiner_name, ''), 'Unassigned') AS examiner, coalesce(nullif(exam, ''), '—') AS exam_code,
coalesce(printf('%.2f', nullif(total_marks, 0)), '—') AS marks_text, quality_status FROM evaluations LEFT JOIN examiners USING (examiner_id) WHERE status = 'APPROVED'""")  # fmt: skip
def export_ledger_csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).where("status = 'APPROVED'").join(domain.examiners(spark, sf_dir), "examiner_id", "left")
    total = F.when(F.col("total_marks") != 0, F.format_string("%.2f", "total_marks"))
    return rows.select("evaluation_id", falsy(F.col("examiner_name"), "Unassigned").alias("examiner"), falsy(F.col("exam"), "—").alias("exam_code"), F.coalesce(total, F.lit("—")).alias("marks_text"), "quality_status")


@query(D + """SELECT question_id, evaluation_id, marks FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY marked_at DESC, evaluation_id DESC, question_number DESC, marks DESC) AS r FROM marks) WHERE r = 1""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct("marked_at", "evaluation_id", "question_number", "marks"))  # combined on the map side, unlike a window
    return domain.marks(spark, sf_dir).groupBy("question_id").agg(best.alias("b")).select("question_id", "b.evaluation_id", "b.marks")
