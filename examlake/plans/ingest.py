"""Queries of merges, fallbacks, continuation pages, exports and page geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import js_round
from ..functions.shares import n_shares
from ..operators import geometry
from ..sources import domain, ingest
from ..sources.domain import SQL as D
from .registry import registry
from .statistics import rounded

QUERIES, ORACLE, query = registry()


@query(D + """, c AS (SELECT evaluation_id, mark_status, CASE WHEN reviewed THEN marks END AS marks, row_number() OVER (PARTITION BY evaluation_id ORDER BY marked_at DESC, question_number DESC, question_id DESC, moderator_id DESC, amount DESC) AS r FROM marks),
n AS (SELECT evaluation_id, max(mark_status) FILTER (r = 1) AS status, arg_min(marks, r) FILTER (marks IS NOT NULL) AS total_marks FROM c GROUP BY 1)
SELECT evaluation_id, coalesce(n.status, e.status) AS status, coalesce(n.total_marks, e.total_marks) AS total_marks FROM evaluations e FULL JOIN n USING (evaluation_id)""")  # fmt: skip
def merge_latest_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = domain.evaluations(spark, sf_dir).select("evaluation_id", "status", "total_marks")
    newest = F.struct("marked_at", "question_number", "question_id", "moderator_id", "amount")
    changes = domain.marks(spark, sf_dir).select("evaluation_id", F.col("mark_status").alias("status"), F.when(F.col("reviewed"), F.col("marks")).alias("total_marks"), newest.alias("at"))
    return ingest.merged(current, changes, ["evaluation_id"], "at")


@query(D + """, known AS (SELECT DISTINCT evaluation_id, question_number FROM marks WHERE mark_status = 'MARKED'),
i AS (SELECT evaluation_id, question_number, row_number() OVER (PARTITION BY evaluation_id, question_number) AS k FROM marks WHERE mark_status <> 'MARKED')
SELECT (k.evaluation_id IS NULL AND i.k = 1) AS inserted, count(*) AS n, count(DISTINCT evaluation_id) AS evaluations FROM i LEFT JOIN known k USING (evaluation_id, question_number) GROUP BY 1""")  # fmt: skip
def insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, keys = domain.marks(spark, sf_dir), ["evaluation_id", "question_number"]
    new, refused = ingest.insert_new(marks.where("mark_status = 'MARKED'").select(*keys), marks.where("mark_status <> 'MARKED'").select(*keys, "question_id"), keys)
    rows = new.withColumn("inserted", F.lit(True)).unionByName(refused.withColumn("inserted", F.lit(False)))
    return rows.groupBy("inserted").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("evaluation_id").alias("evaluations"))


@query(D + """, own AS (SELECT evaluation_id, count(*) AS n, sum(max_marks) AS m FROM marks JOIN questions USING (question_id) GROUP BY 1),
exam_own AS (SELECT exam, n, m FROM (SELECT exam, n, m, row_number() OVER (PARTITION BY exam ORDER BY started_at DESC, evaluation_id DESC) AS r FROM evaluations JOIN own USING (evaluation_id) JOIN examiners USING (examiner_id) WHERE status = 'APPROVED') WHERE r = 1)
SELECT evaluation_id, CASE WHEN o.n IS NOT NULL THEN 'LINKED' WHEN x.n IS NOT NULL THEN 'EXAM' ELSE 'SYNTHETIC' END AS source, coalesce(o.n, x.n, 10)::BIGINT AS n_questions, coalesce(o.m, x.m, 100)::DOUBLE AS total_max,
floor(coalesce(o.m, x.m, 100)::DOUBLE / coalesce(o.n, x.n, 10) * 100 + 0.5::DOUBLE) / 100 AS mean_max FROM evaluations e LEFT JOIN own o USING (evaluation_id) LEFT JOIN examiners USING (examiner_id) LEFT JOIN exam_own x USING (exam)""")  # fmt: skip
def question_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = domain.marks(spark, sf_dir).join(domain.questions(spark, sf_dir).select("question_id", "max_marks"), "question_id").groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("n"), F.sum("max_marks").alias("m"))
    evaluations = domain.evaluations(spark, sf_dir).join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id", "left")
    best = F.max(F.struct("started_at", "evaluation_id", "n", "m"))
    exam = evaluations.where("status = 'APPROVED'").join(own, "evaluation_id").groupBy("exam").agg(best.alias("b")).select("exam", F.col("b.n").alias("xn"), F.col("b.m").alias("xm"))
    rows = evaluations.join(own, "evaluation_id", "left").join(exam, "exam", "left")
    n, m = F.coalesce("n", "xn", F.lit(10)).cast("bigint"), F.coalesce("m", "xm", F.lit(100)).cast("double")
    source = F.when(F.col("n").isNotNull(), "LINKED").when(F.col("xn").isNotNull(), "EXAM").otherwise("SYNTHETIC")
    return rows.select("evaluation_id", source.alias("source"), n.alias("n_questions"), m.alias("total_max"), js_round(m / n, 2).alias("mean_max"))


@query(D + """SELECT evaluation_id, 'exams/' || exam || '/answer-books/' || evaluation_id || '/pages/page-' || lpad(CAST(question_number AS VARCHAR), 4, '0') AS object_key, count(*) AS n
FROM marks JOIN evaluations USING (evaluation_id) JOIN examiners USING (examiner_id) GROUP BY ALL""")  # fmt: skip
def page_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Numbers are counted before keys are written out, and all of a book is dealt to one task.
    marks = domain.marks(spark, sf_dir)
    pages = marks.select("evaluation_id", "question_number").repartition(n_shares(marks), "evaluation_id").groupBy("evaluation_id", "question_number").agg(F.count(F.lit(1)).alias("n"))
    books = domain.evaluations(spark, sf_dir).select("evaluation_id", "examiner_id").join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id").select("evaluation_id", "exam")
    rows = pages.join(books, "evaluation_id").select("evaluation_id", ingest.object_key(F.col("exam"), F.col("evaluation_id"), F.col("question_number").cast("int")).alias("object_key"), "n")
    return rows.groupBy("evaluation_id", "object_key").agg(F.sum("n").alias("n"))


@query(D + """, s AS (SELECT evaluation_id, max(question_number) AS expected, count(*) AS n, count(DISTINCT question_number) AS d, min(question_number) AS low, max(question_number) AS top, count(*) FILTER (mark_status = 'FLAGGED') AS bad, count(*) FILTER (NOT reviewed) AS busy FROM marks GROUP BY 1)
SELECT evaluation_id, array_to_string(list_filter([CASE WHEN n <> expected THEN 'PAGE_COUNT_MISMATCH' END, CASE WHEN d <> n THEN 'DUPLICATE_PAGES' END, CASE WHEN low <> 1 OR top <> d THEN 'PAGES_NOT_SEQUENTIAL' END,
CASE WHEN bad > 0 THEN 'QUALITY_NOT_PASSED' END, CASE WHEN busy > 0 THEN 'STILL_PROCESSING' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""")  # fmt: skip
def script_finalization_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question_number")
    s = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(q).alias("d"), F.min(q).alias("low"), F.max(q).alias("top"), F.count_if(F.col("mark_status") == "FLAGGED").alias("bad"), F.count_if(~F.col("reviewed")).alias("busy")
    )
    problems = ingest.finalization_problems(F.col("top"), F.col("n"), F.col("d"), F.col("low"), F.col("top"), F.col("bad"), F.col("busy"))
    return s.select("evaluation_id", F.array_join(problems, ",").alias("problems"))


@query(D + """, s AS (SELECT evaluation_id, list_sort(list_distinct(list(question_number))) AS seen, list_sort(list_distinct(list(question_number) FILTER (reviewed))) AS done, max(question_number) AS top FROM marks GROUP BY 1)
SELECT evaluation_id, array_to_string(list_filter(range(1, top + 1), lambda x: NOT list_contains(seen, x)), ',') AS missing, array_to_string(list_filter(seen, lambda x: NOT coalesce(list_contains(done, x), false)), ',') AS unreviewed, len(seen) = coalesce(len(done), 0) AS complete FROM s""")  # fmt: skip
def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(F.collect_set("question_number").alias("seen"), F.collect_set(F.when(F.col("reviewed"), F.col("question_number"))).alias("done"), F.max("question_number").alias("top"))
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    return s.select("evaluation_id", text(F.array_except(F.sequence(F.lit(1).cast("int"), F.col("top").cast("int")), F.col("seen").cast("array<int>"))).alias("missing"), text(F.array_except("seen", "done")).alias("unreviewed"), (F.size("seen") == F.size("done")).alias("complete"))


@query(D + """, s AS (SELECT exam, count(*) FILTER (quality_status = 'RESCAN_REQUIRED') AS flagged, count(*) AS n FROM evaluations JOIN examiners USING (examiner_id) GROUP BY 1)
SELECT exam, flagged * 5 * 18 AS page_seconds, flagged * 14 AS isolated_seconds, floor(flagged / 5)::BIGINT * 16 AS hierarchical_seconds, n FROM s""")  # fmt: skip
def review_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id")
    s = rows.groupBy("exam").agg(F.count_if(F.col("quality_status") == "RESCAN_REQUIRED").alias("flagged"), F.count(F.lit(1)).alias("n"))
    return s.select("exam", (F.col("flagged") * 90).alias("page_seconds"), (F.col("flagged") * 14).alias("isolated_seconds"), (F.floor(F.col("flagged") / 5) * 16).alias("hierarchical_seconds"), "n")


@query(D + """SELECT evaluation_id, '{"evaluationId":' || evaluation_id || ',"status":"' || status || '","examiner":' || coalesce('"' || examiner_name || '"', 'null') || '}' AS record FROM evaluations LEFT JOIN examiners USING (examiner_id) WHERE status = 'SUBMITTED'""")
def export_json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).where("status = 'SUBMITTED'").join(domain.examiners(spark, sf_dir).select("examiner_id", "examiner_name"), "examiner_id", "left")
    record = F.to_json(F.struct(F.col("evaluation_id").alias("evaluationId"), "status", F.col("examiner_name").alias("examiner")), {"ignoreNullFields": "false"})
    return rows.select("evaluation_id", record.alias("record"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(regexp_replace(html, '(?s)<[^>]*>', '', 'g'))::BIGINT AS text_chars, len(regexp_extract_all(html, '(?i)<a[ >]'))::BIGINT AS n_links FROM pages")
def page_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return domain.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.char_length(F.regexp_replace(html, "(?s)<[^>]*>", "")).cast("bigint").alias("text_chars"), F.size(F.regexp_extract_all(html, F.lit("(?i)<a[ >]"), F.lit(0))).cast("bigint").alias("n_links")
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks as boxes on the page of their evaluation."""
    line = domain.table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("box"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 200).alias("x1"), (F.col("l_discount") * 100 + 300).alias("y1"))


@query()
def iou_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.greedy_boxes(boxes(spark, sf_dir), 0.90)


@query()
def stable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = domain.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value") / 1000).alias("movement"))
    return geometry.hysteresis(frames, "user_id", "event_id", "movement")


@query("""WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS bx, embedding[4]::DOUBLE AS by_, embedding[5]::DOUBLE AS cx, embedding[6]::DOUBLE AS cy, embedding[7]::DOUBLE AS dx, embedding[8]::DOUBLE AS dy FROM embeddings),
d AS (SELECT vec_id, sqrt(ax * ax + ay * ay) AS a, sqrt(bx * bx + by_ * by_) AS b, sqrt(cx * cx + cy * cy) AS c, sqrt(dx * dx + dy * dy) AS d FROM q) SELECT vec_id, round((a + b + c + d) / 4, 6) AS mean_distance, round(greatest(a, b, c, d), 6) AS max_distance FROM d""")  # fmt: skip
def corner_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    corners = F.array(*[F.struct(e(2 * i).alias("x"), e(2 * i + 1).alias("y")) for i in range(4)])
    origin = F.array(*[F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")) for _ in range(4)])
    rows = domain.table(spark, sf_dir, "embeddings").select("vec_id", geometry.corner_distances(corners, origin).alias("d")).select("vec_id", "d.*")
    return rounded(rows, "mean_distance", "max_distance")
