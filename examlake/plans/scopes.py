"""Queries of scans with scopes and optional filters, of guarded writes, of sets and of issue records, with their SQL.

The tables have no examination fields of their own, so columns stand in: an exam is a market segment, a paper a brand, an
answer book an evaluation with the state that ``rules.book_status`` gives it, a role's scope is the examiner's or moderator's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import cents, clamp, first_failure, js_round
from ..operators import scopes as ops
from ..operators.rules import joined_before
from ..sources import domain
from ..sources.domain import SQL as D
from .registry import registry
from .rules import _BOOK, _C, book_status

QUERIES, ORACLE, query = registry()

_BOOKS = f", books AS (SELECT evaluation_id AS book_id, examiner_id, e.exam, {_BOOK} AS status, started_at AS created_at, quality_status FROM evaluations LEFT JOIN examiners e USING (examiner_id))\n"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).withColumn("book", book_status()).join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id", "left")
    return rows.select(F.col("evaluation_id").alias("book_id"), "examiner_id", "exam", F.col("book").alias("status"), F.col("started_at").alias("created_at"), "quality_status")


@query("SELECT c_custkey AS user_id, c_name AS name, c_acctbal > 0 AS active FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey DESC")
def users_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = domain.examiners(spark, sf_dir).select(F.col("examiner_id").alias("user_id"), F.col("examiner_name").alias("name"), F.lit("EXAMINER").alias("role"), (F.col("load") > 0).alias("active"))
    return ops.filtered(users, role="EXAMINER", active=True).select("user_id", "name", "active").orderBy(F.col("user_id").desc())


@query("SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS exam FROM customer WHERE c_acctbal > 0 ORDER BY name")
def active_examiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.examiners(spark, sf_dir).where("load > 0").select(F.col("examiner_id").alias("user_id"), F.col("examiner_name").alias("name"), "exam").orderBy("name")


@query(D + """, x AS (SELECT exam, year(started_at) AS session_year, max(started_at) AS created_at, min(examiner_id) AS created_by, count(*) FILTER (status = 'APPROVED') = count(*) AS done FROM evaluations JOIN examiners USING (examiner_id) GROUP BY ALL)
SELECT x.exam, session_year, created_at, examiner_name AS creator FROM x LEFT JOIN examiners e ON e.examiner_id = created_by WHERE session_year = 1995 AND NOT done ORDER BY created_at DESC, x.exam""")  # fmt: skip
def exams_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = domain.examiners(spark, sf_dir)
    rows = domain.evaluations(spark, sf_dir).join(people.select("examiner_id", "exam"), "examiner_id").withColumn("session_year", F.year("started_at").cast("bigint"))
    exams = rows.groupBy("exam", "session_year").agg(F.max("started_at").alias("created_at"), F.min("examiner_id").alias("created_by"), (F.count_if(F.col("status") == "APPROVED") == F.count(F.lit(1))).alias("done"))
    creators = people.select(F.col("examiner_id").alias("created_by"), F.col("examiner_name").alias("creator"))
    return ops.filtered(exams, session_year=1995, done=False).join(creators, "created_by", "left").select("exam", "session_year", "created_at", "creator").orderBy(F.col("created_at").desc(), "exam")


@query("SELECT p_partkey AS question_id, p_name AS text, p_size AS max_marks FROM part WHERE p_brand = 'Brand#13' ORDER BY p_partkey")
def questions_by_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of one paper in their order; a paper that no question has gives no row, which callers report."""
    return ops.filtered(domain.questions(spark, sf_dir), paper="Brand#13").select("question_id", "text", "max_marks").orderBy("question_id")


@query(D + _BOOKS + "SELECT book_id, books.exam, status, examiner_name FROM books LEFT JOIN examiners USING (examiner_id) WHERE books.exam = 'BUILDING' AND examiner_id % 10 = 1 ORDER BY created_at DESC, book_id")
def books_of_examiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An examiner sees assigned books alone; here each tenth examiner stands for the one who asks."""
    rows = ops.in_scope(ops.filtered(books(spark, sf_dir), exam="BUILDING", status="ALL"), "EXAMINER", F.col("examiner_id") % 10 == 1)
    return rows.join(domain.examiners(spark, sf_dir).select("examiner_id", "examiner_name"), "examiner_id", "left").orderBy(F.col("created_at").desc(), "book_id").select("book_id", "exam", "status", "examiner_name")


@query(D + "SELECT evaluation_id, status, exam FROM evaluations LEFT JOIN examiners USING (examiner_id) WHERE status = 'APPROVED' AND examiner_id % 10 = 1")
def evaluations_of_examiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.in_scope(ops.filtered(domain.evaluations(spark, sf_dir), status="APPROVED"), "EXAMINER", F.col("examiner_id") % 10 == 1)
    return rows.join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id", "left").select("evaluation_id", "status", "exam")


_MODES = ("DEFAULT", "ALL", "APPROVED")


@query(D + """SELECT mode, evaluation_id, status FROM evaluations, (VALUES ('DEFAULT'), ('ALL'), ('APPROVED')) t(mode)
WHERE CASE mode WHEN 'DEFAULT' THEN status IN ('SUBMITTED', 'UNDER_REVIEW') WHEN 'ALL' THEN status IN ('SUBMITTED', 'UNDER_REVIEW', 'APPROVED', 'RETURNED') ELSE status = mode END""")  # fmt: skip
def moderation_queue_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).select("evaluation_id", "status", "started_at")
    in_mode = F.array_compact(F.array(*[F.when(ops.queue_mode(F.col("status"), None if m == "DEFAULT" else m), m) for m in _MODES]))
    shown = rows.select(F.explode(in_mode).alias("mode"), "evaluation_id", "status", "started_at")
    return shown.orderBy("mode", F.col("started_at").desc(), "evaluation_id").drop("started_at")  # latest first, as the queue is shown


@query(D + """SELECT moderator_name, m.evaluation_id, question_number, v.status, e.examiner_name, e.exam, marked_at FROM marks m JOIN moderators USING (moderator_id) LEFT JOIN evaluations v ON v.evaluation_id = m.evaluation_id LEFT JOIN examiners e USING (examiner_id)
WHERE moderator_id = 3 AND reviewed""")  # fmt: skip
def moderator_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.filtered(domain.marks(spark, sf_dir), moderator_id=3, reviewed=True).join(domain.moderators(spark, sf_dir).select("moderator_id", "moderator_name"), "moderator_id")
    whole = rows.join(domain.evaluations(spark, sf_dir).select("evaluation_id", "status", "examiner_id"), "evaluation_id", "left").join(domain.examiners(spark, sf_dir), "examiner_id", "left")
    return whole.select("moderator_name", "evaluation_id", "question_number", "status", "examiner_name", "exam", "marked_at").orderBy(F.col("marked_at").desc(), "evaluation_id", "question_number")


_RESULTS = """, results AS (SELECT evaluation_id AS result_id, evaluation_id, examiner_id, exam, examiner_name, institution, total_marks, started_at AS finalized_at, CASE quality_status WHEN 'PASSED' THEN 'PUBLISHED' ELSE 'WITHHELD' END AS status
FROM evaluations LEFT JOIN examiners USING (examiner_id) LEFT JOIN institutions USING (institution_id) WHERE status = 'APPROVED')
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results: approved evaluations with their dimensions."""
    people = domain.examiners(spark, sf_dir).join(F.broadcast(domain.institutions(spark, sf_dir)), "institution_id", "left")  # one row for each nation
    rows = domain.evaluations(spark, sf_dir).where("status = 'APPROVED'").join(people, "examiner_id", "left")
    return rows.select(F.col("evaluation_id").alias("result_id"), "evaluation_id", "examiner_id", "exam", "examiner_name", "institution", "total_marks", F.col("started_at").alias("finalized_at"), F.when(F.col("quality_status") == "PASSED", "PUBLISHED").otherwise("WITHHELD").alias("status"))


@query(D + _RESULTS + "SELECT result_id, exam, examiner_name, institution, total_marks, status FROM results WHERE exam = 'MACHINERY' ORDER BY finalized_at DESC, result_id")
def results_of_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filtered(results(spark, sf_dir), exam="MACHINERY", status="ALL").orderBy(F.col("finalized_at").desc(), "result_id").select("result_id", "exam", "examiner_name", "institution", "total_marks", "status")


@query(D + """, asked AS (SELECT l_orderkey * 2 AS asked FROM lineitem UNION SELECT l_orderkey FROM lineitem), byid AS (SELECT a.asked, e.evaluation_id FROM asked a JOIN evaluations e ON e.evaluation_id = a.asked), other AS (SELECT a.asked, max(m.evaluation_id) AS evaluation_id FROM asked a JOIN marks m ON m.question_id = a.asked GROUP BY 1)
SELECT asked, coalesce(b.evaluation_id, o.evaluation_id) AS evaluation_id, b.evaluation_id IS NULL AS by_other_key FROM asked LEFT JOIN byid b USING (asked) LEFT JOIN other o USING (asked) WHERE coalesce(b.evaluation_id, o.evaluation_id) IS NOT NULL""")  # fmt: skip
def lookup_by_either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id is looked up as an evaluation's, else as a question's (its latest evaluation)."""
    marks = domain.marks(spark, sf_dir)
    asked = marks.select((F.col("evaluation_id") * 2).alias("asked")).union(marks.select("evaluation_id")).distinct()
    own = domain.evaluations(spark, sf_dir).select(F.col("evaluation_id").alias("asked"), F.col("evaluation_id").alias("first"))
    other = marks.groupBy(F.col("question_id").alias("asked")).agg(F.max("evaluation_id").alias("second"))
    found = asked.join(own, "asked", "left").join(other, "asked", "left")
    return found.select("asked", F.coalesce("first", "second").alias("evaluation_id"), F.col("first").isNull().alias("by_other_key")).where("evaluation_id is not null")


@query("SELECT user_id, last FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) WHERE last IN ('view', 'click')")
def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose nested state is still queued or running."""
    jobs = domain.table(spark, sf_dir, "events").groupBy("user_id").agg(F.struct(F.max(F.struct("ts", "event_id", "event_type")).getField("event_type").alias("state")).alias("job"))
    return jobs.where(F.col("job.state").isin("view", "click")).select("user_id", F.col("job.state").alias("last"))


@query(D + _BOOKS + "SELECT exam, count(*) FILTER (status IN ('READY', 'RETURNED')) AS assignable, count(*) FILTER (status = 'READY' AND examiner_id IS NULL) AS unassigned, count(*) FILTER (quality_status = 'RESCAN_REQUIRED' OR status = 'FAILED') AS defective FROM books GROUP BY 1")
def assignable_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return books(spark, sf_dir).groupBy("exam").agg(
        F.count_if(s.isin("READY", "RETURNED")).alias("assignable"), F.count_if((s == "READY") & F.col("examiner_id").isNull()).alias("unassigned"), F.count_if((F.col("quality_status") == "RESCAN_REQUIRED") | (s == "FAILED")).alias("defective")
    )


@query(D + f"SELECT evaluation_id FROM (SELECT *, {_BOOK} AS book FROM evaluations) e WHERE status = 'APPROVED' AND book <> 'FINALIZED' AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.evaluation_id = e.evaluation_id AND m.mark_status = 'FLAGGED')")
def approved_awaiting_finalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved, the book not final and nothing flagged yet."""
    flagged = domain.marks(spark, sf_dir).where("mark_status = 'FLAGGED'")
    return domain.evaluations(spark, sf_dir).where(F.col("status") == "APPROVED").where(book_status() != "FINALIZED").select("evaluation_id").join(flagged, "evaluation_id", "left_anti")


@query(D + "SELECT DISTINCT evaluation_id FROM marks WHERE mark_status = 'FLAGGED'")
def flagged_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(F.collect_set("mark_status").alias("states"))
    return lists.where(F.array_contains("states", "FLAGGED")).select("evaluation_id")


@query(D + "SELECT a.evaluation_id, count(DISTINCT b.evaluation_id) AS others FROM evaluations a JOIN evaluations b ON a.examiner_id = b.examiner_id AND b.started_at = a.started_at AND b.evaluation_id <> a.evaluation_id AND b.status IN ('SUBMITTED', 'APPROVED') GROUP BY 1")
def other_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other submitted or approved evaluations of the same examiner and day."""
    rows = domain.evaluations(spark, sf_dir).select("evaluation_id", "examiner_id", "started_at", "status")
    other = rows.where(F.col("status").isin("SUBMITTED", "APPROVED")).select(F.col("evaluation_id").alias("other"), "examiner_id", "started_at")
    return rows.join(other, ["examiner_id", "started_at"]).where("other <> evaluation_id").groupBy("evaluation_id").agg(F.count_distinct("other").alias("others"))


# Writes: each gives the table as it stands afterwards, or what was written.


@query(D + _BOOKS + """, incoming AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE -l_orderkey END AS book_id, max(CASE WHEN l_linestatus = 'F' THEN 'scan' || l_suppkey END) AS scanner FROM lineitem GROUP BY 1)
SELECT i.book_id, CASE WHEN b.book_id IS NULL THEN 'INSERTED' WHEN b.status = 'RETURNED' THEN 'RESUMED' ELSE 'CONFLICT' END AS outcome, CASE WHEN b.book_id IS NULL OR b.status = 'RETURNED' THEN coalesce(scanner, b.exam, 'none') ELSE b.exam END AS kept FROM incoming i LEFT JOIN books b USING (book_id)""")  # fmt: skip
def create_or_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code that exists is patched with what is given where its state allows (RETURNED here), else refused; a new one is inserted with defaults."""
    line = domain.table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).otherwise(-F.col("l_orderkey"))
    incoming = line.groupBy(code.alias("book_id")).agg(F.max(F.when(F.col("l_linestatus") == "F", F.concat(F.lit("scan"), F.col("l_suppkey").cast("string")))).alias("scanner"))
    both = incoming.join(books(spark, sf_dir).select("book_id", "exam", "status"), "book_id", "left")
    outcome = F.when(F.col("status").isNull(), "INSERTED").when(F.col("status") == "RETURNED", "RESUMED").otherwise("CONFLICT")
    return both.select("book_id", outcome.alias("outcome"), F.when(outcome != "CONFLICT", F.coalesce("scanner", "exam", F.lit("none"))).otherwise(F.col("exam")).alias("kept"))


@query(D + _RESULTS + "SELECT exam, count(*) FILTER (status = 'WITHHELD' AND exam = 'BUILDING') AS modified, count(*) FILTER (CASE WHEN status = 'WITHHELD' AND exam = 'BUILDING' THEN 'PUBLISHED' ELSE status END = 'PUBLISHED') AS published FROM results GROUP BY 1")
def bulk_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All withheld results of one exam are published at once; how many changed, and how many are public then."""
    hit = (F.col("status") == "WITHHELD") & (F.col("exam") == "BUILDING")
    after = ops.updated(results(spark, sf_dir), hit, status=F.lit("PUBLISHED"))
    return after.groupBy("exam").agg(F.count_if("_changed").alias("modified"), F.count_if(F.col("status") == "PUBLISHED").alias("published"))


@query(D + "SELECT evaluation_id, count(*) AS pages, count(*) FILTER (NOT reviewed) AS newly_final FROM marks JOIN evaluations USING (evaluation_id) WHERE status = 'APPROVED' GROUP BY 1")
def finalize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of an approved book is marked final."""
    approved = domain.evaluations(spark, sf_dir).where("status = 'APPROVED'").select("evaluation_id")
    after = ops.updated(domain.marks(spark, sf_dir).join(approved, "evaluation_id", "left_semi"), ~F.col("reviewed"), reviewed=F.lit(True))
    return after.groupBy("evaluation_id").agg(F.count_if("reviewed").alias("pages"), F.count_if("_changed").alias("newly_final"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'click') AS needs_review, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def counter_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters are sums over the increments, never changed in place."""
    kind = F.col("event_type")
    steps = domain.table(spark, sf_dir, "events").select("user_id", *[(kind == k).cast("int").alias(n) for k, n in (("purchase", "completed"), ("click", "needs_review"), ("error", "failed"))])
    return steps.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in ("completed", "needs_review", "failed")])


@query(D + "SELECT examiner_id, EXISTS (SELECT 1 FROM evaluations v WHERE v.examiner_id = e.examiner_id) AS refused FROM examiners e")
def guarded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what nothing refers to may be deleted."""
    people, used = domain.examiners(spark, sf_dir).select("examiner_id"), domain.evaluations(spark, sf_dir).select("examiner_id")
    free, kept = ops.deletable(people, used, "examiner_id")
    return free.withColumn("refused", F.lit(False)).unionByName(kept.withColumn("refused", F.lit(True)))


@query(D + "SELECT evaluation_id, count(*) FILTER (mark_status <> 'NOT_ATTEMPTED') AS page_count, count(*) FILTER (mark_status = 'NOT_ATTEMPTED') AS deleted FROM marks GROUP BY 1")
def delete_pages_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages go and each book's page count becomes the number of those that remain, 0 included."""
    pages = domain.marks(spark, sf_dir).select("evaluation_id", "mark_status")
    gone = F.col("mark_status") == "NOT_ATTEMPTED"
    return pages.groupBy("evaluation_id").agg(F.count_if(~gone).alias("page_count"), F.count_if(gone).alias("deleted"))


@query("""SELECT p_partkey AS question_id, CASE WHEN p_size % 2 = 0 THEN 'Q: ' || p_name ELSE p_name END AS text, CASE WHEN p_size % 2 = 0 THEN p_size + 1 ELSE p_size END AS max_marks FROM part
UNION ALL SELECT -p_partkey, 'Q: ' || p_name, p_size + 1 FROM part WHERE p_size % 10 = 0""")  # fmt: skip
def question_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified questions of a paper go into the questions: known ones are replaced, new ones added, others stay."""
    known = domain.questions(spark, sf_dir).select("question_id", "text", "max_marks")
    verified = known.where("max_marks % 2 = 0").unionByName(known.where("max_marks % 10 = 0").withColumn("question_id", -F.col("question_id")))
    verified = verified.select("question_id", F.concat(F.lit("Q: "), F.col("text")).alias("new_text"), (F.col("max_marks") + 1).alias("new_marks"))
    both = known.join(verified, "question_id", "full_outer")
    return both.select("question_id", F.coalesce("new_text", "text").alias("text"), F.coalesce("new_marks", "max_marks").alias("max_marks"))


# Counters and sets.


@query("SELECT count(*) FILTER (event_type = 'signup') AS received, count(*) FILTER (event_type = 'view') AS processing, count(*) FILTER (event_type = 'click') AS ocr_processing, 0::BIGINT AS quality_review, 0::BIGINT AS rescan_required, count(*) FILTER (event_type = 'purchase') AS finalized, count(*) FILTER (event_type = 'error') AS failed FROM events")
def monitoring_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    state = F.when(e == "signup", "received").when(e == "view", "processing").when(e == "click", "ocr_processing").when(e == "purchase", "finalized").when(e == "error", "failed")
    buckets = ("received", "processing", "ocr_processing", "quality_review", "rescan_required", "finalized", "failed")
    return domain.table(spark, sf_dir, "events").select(state.alias("s")).agg(*[F.count_if(F.col("s") == b).alias(b) for b in buckets])


@query(D + "SELECT moderator_id, count(*) FILTER (mark_status = 'MARKED') AS approvals, count(*) FILTER (mark_status = 'FLAGGED') AS returns, count(*) AS total FROM marks GROUP BY 1")
def decision_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("mark_status")
    return domain.marks(spark, sf_dir).groupBy("moderator_id").agg(F.count_if(s == "MARKED").alias("approvals"), F.count_if(s == "FLAGGED").alias("returns"), F.count(F.lit(1)).alias("total"))


@query("SELECT p_brand AS paper, count(*) AS n_questions, sum(p_size)::BIGINT AS total_marks FROM part GROUP BY 1")
def paper_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.questions(spark, sf_dir).groupBy("paper").agg(F.count(F.lit(1)).alias("n_questions"), F.sum("max_marks").alias("total_marks"))


@query("SELECT l_orderkey AS evaluation_id, round(avg(CASE WHEN l_returnflag <> 'N' THEN 1 - l_discount END), 6) AS mean_confidence FROM lineitem GROUP BY 1")
def mean_ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over pages that have a confidence; null where none has."""
    known = F.when(F.col("l_returnflag") != "N", 1 - F.col("l_discount"))
    return domain.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("evaluation_id")).agg(F.round(F.avg(known), 6).alias("mean_confidence"))


_SORTED = "SELECT evaluation_id, question_number, question_id, moderator_id, mark_status, row_number() OVER (PARTITION BY evaluation_id ORDER BY question_number, question_id, moderator_id, amount) AS k FROM marks"


@query(D + f""", s AS ({_SORTED}), f AS (SELECT evaluation_id, moderator_id, min(k) AS k FROM s GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id, question_number ORDER BY k DESC) AS r FROM s)
SELECT evaluation_id, (SELECT array_to_string(list(moderator_id ORDER BY k), ',') FROM f WHERE f.evaluation_id = e.evaluation_id) AS moderators, (SELECT array_to_string(list(moderator_id ORDER BY k) [1:3], ',') FROM f WHERE f.evaluation_id = e.evaluation_id) AS first_three,
(SELECT array_to_string(list(question_id ORDER BY question_number), ',') FROM l WHERE l.evaluation_id = e.evaluation_id AND r = 1) AS last_by_number FROM (SELECT DISTINCT evaluation_id FROM marks) e""")  # fmt: skip
def ordered_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderators in order of first appearance, at most three of them, and the last entry of each question number."""
    rows = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(F.array_sort(F.collect_list(F.struct("question_number", "question_id", "moderator_id", "amount"))).alias("m"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    seen = F.array_distinct("m.moderator_id")
    last = F.filter("m", lambda x, i: (i == F.size("m") - 1) | (F.get("m", i + 1).getField("question_number") != x.question_number))
    return rows.select("evaluation_id", text(seen).alias("moderators"), text(F.slice(seen, 1, 3)).alias("first_three"), text(F.transform(last, lambda x: x.question_id)).alias("last_by_number"))


@query(D + """, s AS (SELECT evaluation_id, list_sort(list_distinct(list(question_number) FILTER (mark_status = 'NOT_ATTEMPTED'))) AS failed, list_sort(list_distinct(list(question_number) FILTER (NOT reviewed))) AS unverified FROM marks GROUP BY 1)
SELECT evaluation_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(failed, []), coalesce(unverified, [])))), ',') AS open_pages, coalesce(failed, []) = coalesce(unverified, []) AS same_pages FROM s""")  # fmt: skip
def open_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed and unverified page numbers in one sorted list, and whether both lists hold the same pages."""
    number = F.col("question_number")
    s = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(F.collect_set(F.when(F.col("mark_status") == "NOT_ATTEMPTED", number)).alias("failed"), F.collect_set(F.when(~F.col("reviewed"), number)).alias("unverified"))
    union = F.transform(F.array_sort(F.array_union("failed", "unverified")), lambda x: x.cast("string"))
    return s.select("evaluation_id", F.array_join(union, ",").alias("open_pages"), (F.array_sort("failed") == F.array_sort("unverified")).alias("same_pages"))


# Rules.


@query(D + f""", m AS (SELECT *, count(*) OVER (PARTITION BY examiner_id, started_at) AS n FROM evaluations), x AS (SELECT evaluation_id, sum(max_marks) AS mx FROM marks JOIN questions USING (question_id) GROUP BY 1),
p AS (SELECT evaluation_id, count(*) AS pages FROM marks WHERE mark_status <> 'NOT_ATTEMPTED' GROUP BY 1), names AS (SELECT examiner_id, examiner_name, exam FROM examiners)
SELECT 'duplicate-eval-' || evaluation_id AS issue_id, 'Duplicate Evaluation' AS rule_name, 'HIGH' AS severity, evaluation_id, coalesce(exam, '—') AS exam_code, coalesce(examiner_name, 'Unknown') AS examiner, n || ' evaluations stand for one book.' AS description FROM m LEFT JOIN names USING (examiner_id) WHERE n > 1
UNION ALL SELECT 'exceeds-max-' || evaluation_id, 'Total Above Maximum', 'HIGH', evaluation_id, coalesce(exam, '—'), coalesce(examiner_name, 'Unknown'), 'The total is above the maximum of ' || mx || '.' FROM evaluations JOIN x USING (evaluation_id) LEFT JOIN names USING (examiner_id) WHERE {_C.format('coalesce(total_marks, 0)')} > mx * 100
UNION ALL SELECT 'missing-pages-' || evaluation_id, 'Invalid Page Count', 'MEDIUM', evaluation_id, coalesce(exam, '—'), 'System Scanner', 'Answer book registered with invalid or zero page count (' || coalesce(pages, 0) || ' pages).' FROM evaluations LEFT JOIN p USING (evaluation_id) LEFT JOIN names USING (examiner_id) WHERE coalesce(pages, 0) <= 0
UNION ALL SELECT 'defective-page-' || evaluation_id || '-' || question_number || '-' || question_id, 'Scanned Page Ingestion Defect', 'MEDIUM', evaluation_id, coalesce(exam, '—'), 'Scanner Ingestion', 'Page ' || question_number || ' flagged with ' || CASE WHEN quality_status = 'RESCAN_REQUIRED' THEN 'unacceptable blur/legibility quality score' ELSE 'processing pipeline failure' END || '.'
FROM marks JOIN evaluations USING (evaluation_id) LEFT JOIN names USING (examiner_id) WHERE quality_status = 'RESCAN_REQUIRED' OR mark_status = 'FLAGGED'""")  # fmt: skip
def integrity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue records of duplicate evaluations, totals above the maximum, empty books and defective pages, all of one shape."""
    return records(spark, sf_dir)


def records(spark: SparkSession, sf_dir: str, about: DataFrame | None = None) -> DataFrame:
    """The records, with the other columns of ``about`` by ``evaluation_id``, which are joined before records are made."""
    people = domain.examiners(spark, sf_dir).select("examiner_id", "examiner_name", "exam")
    ev = domain.evaluations(spark, sf_dir).join(people, "examiner_id", "left")
    marks = domain.marks(spark, sf_dir)
    by_book = marks.join(domain.questions(spark, sf_dir).select("question_id", "max_marks"), "question_id", "left").groupBy("evaluation_id").agg(F.sum("max_marks").alias("mx"), F.count_if(F.col("mark_status") != "NOT_ATTEMPTED").alias("pages"))
    same_day = ev.groupBy("examiner_id", "started_at").agg(F.count(F.lit(1)).alias("n"))
    facts = ev.join(by_book, "evaluation_id", "left").join(same_day, ["examiner_id", "started_at"], "left")
    who, e = F.coalesce("examiner_name", F.lit("Unknown")), F.col("evaluation_id").cast("string")
    pages = F.coalesce("pages", F.lit(0))
    also = [] if about is None else [c for c in about.columns if c != "evaluation_id"]
    books_ = ops.issues(
        joined_before(facts, about),
        (F.col("n") > 1, ops.record("duplicate-eval", "Duplicate Evaluation", "HIGH", e, who, F.concat(F.col("n").cast("string"), F.lit(" evaluations stand for one book.")))),
        (cents(F.coalesce("total_marks", F.lit(0.0))) > F.col("mx") * 100, ops.record("exceeds-max", "Total Above Maximum", "HIGH", e, who, F.concat(F.lit("The total is above the maximum of "), F.col("mx").cast("string"), F.lit(".")))),
        (pages <= 0, ops.record("missing-pages", "Invalid Page Count", "MEDIUM", e, F.lit("System Scanner"), F.concat(F.lit("Answer book registered with invalid or zero page count ("), pages.cast("string"), F.lit(" pages).")))),
        also=also,
    )
    bad = marks.join(ev, "evaluation_id").where((F.col("quality_status") == "RESCAN_REQUIRED") | (F.col("mark_status") == "FLAGGED"))
    why = F.when(F.col("quality_status") == "RESCAN_REQUIRED", "unacceptable blur/legibility quality score").otherwise("processing pipeline failure")
    key = F.concat_ws("-", e, F.col("question_number").cast("string"), F.col("question_id").cast("string"))
    page = ops.record("defective-page", "Scanned Page Ingestion Defect", "MEDIUM", key, F.lit("Scanner Ingestion"), F.concat(F.lit("Page "), F.col("question_number").cast("string"), F.lit(" flagged with "), why, F.lit(".")))
    return books_.unionByName(ops.issues(joined_before(bad, about), (F.lit(True), page), also=also))


@query(D + """, q AS (SELECT evaluation_id, question_number, count(*) FILTER (mark_status <> 'NOT_ATTEMPTED') AS pages, bool_or(reviewed) AS verified, max(moderator_id) % 2 = 0 AS current FROM marks GROUP BY ALL), s AS (SELECT evaluation_id, bool_or(pages = 0 AND NOT verified) AS unresolved, bool_or(NOT current AND NOT verified) AS outdated FROM q GROUP BY 1)
SELECT evaluation_id, CASE WHEN s.evaluation_id IS NULL THEN 'EMPTY' WHEN unresolved THEN 'UNRESOLVED' WHEN outdated THEN 'OUTDATED' ELSE 'CURRENT' END AS mapping FROM evaluations LEFT JOIN s USING (evaluation_id)""")  # fmt: skip
def mapping_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a book must be mapped again; what an examiner verified never makes it so."""
    q = domain.marks(spark, sf_dir).groupBy("evaluation_id", "question_number").agg(F.count_if(F.col("mark_status") != "NOT_ATTEMPTED").alias("pages"), F.bool_or("reviewed").alias("verified"), (F.max("moderator_id") % 2 == 0).alias("current"))
    s = q.groupBy("evaluation_id").agg(F.bool_or((F.col("pages") == 0) & ~F.col("verified")).alias("unresolved"), F.bool_or(~F.col("current") & ~F.col("verified")).alias("outdated"), F.lit(True).alias("there"))
    rows = domain.evaluations(spark, sf_dir).select("evaluation_id").join(s, "evaluation_id", "left")
    code = first_failure((F.col("there").isNull(), "EMPTY"), (F.col("unresolved"), "UNRESOLVED"), (F.col("outdated"), "OUTDATED"))
    return rows.select("evaluation_id", F.coalesce(code, F.lit("CURRENT")).alias("mapping"))


_CLAMP = "least(greatest({0}, 0::DOUBLE), {1})"


@query(f"""WITH r AS (SELECT l_orderkey AS evaluation_id, l_linenumber AS question_number, l_partkey AS question_id, l_suppkey AS moderator_id, l_quantity * (1.0::DOUBLE + l_tax) AS s, l_quantity * 2 * l_discount AS lo, l_quantity * 1.5::DOUBLE AS hi, p_size::DOUBLE AS m, 0.97::DOUBLE + l_tax AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT *, {_CLAMP.format('s', 'm')} AS s2 FROM r)
SELECT evaluation_id, question_number, question_id, moderator_id, round(s2, 6) AS suggested, round({_CLAMP.format('lo', 's2')}, 6) AS low, round(least(greatest(hi, s2), m), 6) AS high, round({_CLAMP.format('c', '1::DOUBLE')}, 6) AS confidence FROM k""")  # fmt: skip
def provider_clamping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer's numbers drawn into their ranges: the mark into 0 to the maximum, the band around it, the confidence into 0 to 1."""
    line, part = domain.table(spark, sf_dir, "lineitem"), domain.table(spark, sf_dir, "part")
    q, m = F.col("l_quantity"), F.col("p_size").cast("double")
    s = clamp(q * (1.0 + F.col("l_tax")), 0.0, m)
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").alias("question_number"), F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("moderator_id"),
        r6(s, "suggested"), r6(clamp(q * 2 * F.col("l_discount"), 0.0, s), "low"), r6(F.least(F.greatest(q * 1.5, s), m), "high"), r6(clamp(0.97 + F.col("l_tax"), 0.0, 1.0), "confidence"),
    )


@query("""SELECT l_orderkey AS evaluation_id, l_linenumber AS question_number, l_partkey AS question_id, l_suppkey AS moderator_id, CASE WHEN l_returnflag = 'N' AND (l_discount < 0.03::DOUBLE OR l_discount * 10 < 0.35::DOUBLE) THEN 0 ELSE l_quantity END::DOUBLE AS marks,
(l_returnflag = 'N' AND (l_discount < 0.03::DOUBLE OR l_discount * 10 < 0.35::DOUBLE)) AS needs_review FROM lineitem""")  # fmt: skip
def zero_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an image, a missing or hardly read text gets no marks and a review."""
    d = F.col("l_discount")
    zero = ops.unreadable(F.col("l_returnflag") != "N", d >= 0.03, d * 10)
    return domain.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").alias("question_number"), F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("moderator_id"), F.when(zero, 0.0).otherwise(F.col("l_quantity").cast("double")).alias("marks"), zero.alias("needs_review")
    )


@query("""WITH g AS (SELECT p_partkey AS question_id, p_retailprice % 100 AS percent, CASE WHEN p_size % 3 = 0 THEN 'B' END AS old FROM part) SELECT question_id, coalesce(old, CASE WHEN percent >= 90 THEN 'A+' WHEN percent >= 80 THEN 'A' WHEN percent >= 70 THEN 'B+' WHEN percent >= 60 THEN 'B' WHEN percent >= 50 THEN 'C' WHEN percent >= 40 THEN 'P' ELSE 'F' END) AS grade, old IS NULL AS filled
FROM (SELECT question_id, old, floor(percent * 100 + 0.5::DOUBLE) / 100 AS percent FROM g)""")  # fmt: skip
def grade_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from before grades were kept get theirs from the percentage."""
    from ..operators.rules import grade

    part = domain.table(spark, sf_dir, "part")
    old = F.when(F.col("p_size") % 3 == 0, "B")
    return part.select(F.col("p_partkey").alias("question_id"), F.coalesce(old, grade(F.col("p_retailprice") % 100)[0]).alias("grade"), old.isNull().alias("filled"))


@query("""SELECT doc_id, CASE WHEN source IS NULL OR trim(source) = '' THEN NULL ELSE lower(trim(source)) END AS identity, coalesce(nullif(lower(trim(source)), '') = nullif(lower(trim(lang)), ''), false) AS same FROM documents""")
def identity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are trimmed and lower-cased; an empty or missing one equals nothing."""
    docs = domain.table(spark, sf_dir, "documents")
    return docs.select("doc_id", ops.identity(F.col("source")).alias("identity"), ops.same_identity(F.col("source"), F.col("lang")).alias("same"))


@query(D + """, r AS (SELECT question_id, max_marks::DOUBLE AS m, floor(max_marks * 0.6::DOUBLE + 0.5::DOUBLE) AS a FROM questions), c AS (SELECT question_id, m, least(a, floor(1.76::DOUBLE * a + 0.5::DOUBLE) / 2) + least(m - a, floor(1.76::DOUBLE * (m - a) + 0.5::DOUBLE) / 2) AS t FROM r)
SELECT question_id, t AS suggested, greatest(0::DOUBLE, t - 3) AS low, least(m, t + 2) AS high, 0.94::DOUBLE AS confidence FROM c""")  # fmt: skip
def client_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original's client-side placeholder suggestion: 0.88 of each criterion in halves, a band of -3 and +2, a fixed confidence."""
    m = F.col("max_marks").cast("double")
    first = js_round(m * 0.6)
    total = F.aggregate(F.transform(F.array(first, m - first), lambda c: F.least(c, js_round(c * 1.76) / 2)), F.lit(0.0), lambda x, y: x + y)
    return domain.questions(spark, sf_dir).select("question_id", total.alias("suggested"), F.greatest(F.lit(0.0), total - 3).alias("low"), F.least(m, total + 2).alias("high"), F.lit(0.94).alias("confidence"))


@query(D + """, e AS (SELECT evaluation_id, question_number, question_id, reviewed, row_number() OVER (PARTITION BY evaluation_id, question_number ORDER BY marked_at DESC, question_id DESC, moderator_id DESC, amount DESC) AS k FROM marks), v AS (SELECT evaluation_id, question_number, min(k) FILTER (reviewed) AS k FROM e GROUP BY ALL)
SELECT e.evaluation_id, e.question_number, e.question_id AS page, e.reviewed AS verified, f.question_id IS NOT NULL AND f.question_id <> e.question_id AND e.reviewed AS conflict
FROM e JOIN v ON v.evaluation_id = e.evaluation_id AND v.question_number = e.question_number AND e.k = coalesce(v.k, 1) LEFT JOIN e f ON f.evaluation_id = e.evaluation_id AND f.question_number = e.question_number AND f.k = 1""")  # fmt: skip
def mapping_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest page that an examiner verified stands for a question, else the latest; a later page of another kind is a conflict, kept as a suggestion."""
    at = F.struct("marked_at", "question_id", "moderator_id", "amount", "reviewed")
    s = domain.marks(spark, sf_dir).groupBy("evaluation_id", "question_number").agg(F.max(at).alias("last"), F.max(F.when(F.col("reviewed"), at)).alias("own"))
    chosen = F.coalesce("own", "last")
    return s.select("evaluation_id", "question_number", chosen.getField("question_id").alias("page"), chosen.getField("reviewed").alias("verified"), (F.col("own").isNotNull() & (F.col("last.question_id") != F.col("own.question_id"))).alias("conflict"))


@query("""WITH s AS (SELECT l_orderkey AS evaluation_id, count(*) AS n, string_agg('[model-' || l_suppkey || ': ' || printf('%.1f', l_quantity) || '/50] ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS t, max(l_quantity) - min(l_quantity) AS gap FROM lineitem GROUP BY 1)
SELECT evaluation_id, md5(t || CASE WHEN gap > 7.5::DOUBLE THEN chr(10) || 'Scores differ by ' || printf('%.1f', gap) || '.' ELSE '' END) AS summary FROM s""")  # fmt: skip
def reasoning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each scorer, and a note where they lie far apart."""
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    s = domain.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("evaluation_id")).agg(F.array_sort(F.collect_list(line)).alias("a"), (F.max("l_quantity") - F.min("l_quantity")).alias("gap"))
    text = F.array_join(F.transform("a", lambda x: F.format_string("[model-%s: %.1f/50] %s", x.l_suppkey.cast("string"), x.l_quantity.cast("double"), x.l_returnflag)), "\n")
    note = F.when(F.col("gap") > 7.5, F.format_string("\nScores differ by %.1f.", F.col("gap").cast("double"))).otherwise("")
    return s.select("evaluation_id", F.md5(F.concat(text, note).cast("binary")).alias("summary"))


@query("""SELECT doc_id, length(trim(coalesce(text, ''))) < 20 AS transcribe, CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 0.92::DOUBLE END AS confidence FROM documents""")
def transcription_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with hardly any text are to be transcribed."""
    short = F.char_length(F.trim(F.coalesce("text", F.lit("")))) < 20
    return domain.table(spark, sf_dir, "documents").select("doc_id", short.alias("transcribe"), F.when(short, 0.92).alias("confidence"))


@query("""SELECT user_id, event_id, CASE WHEN value <= 0 THEN 'INSUFFICIENT' WHEN value * 3 < 350 OR value / 1e6 < 0.0000005 THEN 'SPARSE' ELSE 'SUFFICIENT' END AS content,
array_to_string(list_filter([CASE WHEN value > 150 THEN 'SHADOW' END, CASE WHEN value < 52 THEN 'LOW_CONTRAST' END, CASE WHEN value % 16 > 8 THEN 'NOISE' END, CASE WHEN value % 84 < 42 THEN 'SOFT' END], lambda x: x IS NOT NULL), ',') AS flags FROM events""")  # fmt: skip
def page_condition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content sufficiency and condition flags of a page's measures; a measure stands in for each."""
    v = F.col("value")
    content = ops.content_sufficiency(v * 3, v / 1e6, 0.0000005)
    return domain.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(v <= 0, "INSUFFICIENT").otherwise(content).alias("content"), F.array_join(ops.condition_flags(v > 150, v, v % 16, v % 84), ",").alias("flags"))
