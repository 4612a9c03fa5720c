"""Queries of approval, return, assignment and publication gates, histories, texts and what-ifs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import cents, first_failure, js_round
from ..operators import correction, geometry, vision
from ..operators.statistics import percentiles
from ..operators.text import edit_distance
from ..sources import domain
from ..sources.domain import SQL as D
from .ingest import boxes
from .registry import registry
from .rules import _FINAL, _GATE, final_result_gate, gate_facts, submission_problems
from .scoring import _EVIDENCE, _MEASURES, _SCENARIOS, evidence, grids, quality_verdict, scenarios
from .statistics import _r, rounded

QUERIES, ORACLE, query = registry()


@query(D + _GATE + """SELECT evaluation_id, CASE WHEN status NOT IN ('SUBMITTED', 'UNDER_REVIEW') THEN 'WRONG_STATE' WHEN quality_status = 'RESCAN_REQUIRED' THEN 'RESCAN_REQUIRED' WHEN n IS NULL THEN 'NO_MARKS' WHEN failed > 0 THEN 'INVALID_MARKS' WHEN d < top THEN 'MISSING_QUESTIONS'
WHEN unreviewed > 0 THEN 'UNREVIEWED' WHEN undecided > 0 THEN 'QUESTION_DECISION_REQUIRED' WHEN c > m THEN 'ABOVE_MAXIMUM' WHEN abs(a - CAST(floor(total_marks * 100 + 0.5) AS BIGINT)) > 0 THEN 'TOTAL_MISMATCH' ELSE 'OK' END AS outcome FROM g""")  # fmt: skip
def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = first_failure(
        (~F.col("status").isin("SUBMITTED", "UNDER_REVIEW"), "WRONG_STATE"), (F.col("quality_status") == "RESCAN_REQUIRED", "RESCAN_REQUIRED"), (F.col("n").isNull(), "NO_MARKS"), *submission_problems(),
        (F.col("c") > F.col("m"), "ABOVE_MAXIMUM"), (F.abs(F.col("a") - cents(F.col("total_marks"))) > 0, "TOTAL_MISMATCH"),
    )
    return gate_facts(spark, sf_dir).select("evaluation_id", F.coalesce(outcome, F.lit("OK")).alias("outcome"))


@query(D + "SELECT evaluation_id, CASE WHEN length(trim(substr(paper_set, 3, 6))) < 5 THEN 'REASON_TOO_SHORT' WHEN status NOT IN ('SUBMITTED', 'UNDER_REVIEW') THEN 'WRONG_STATE' ELSE 'OK' END AS outcome FROM evaluations")
def return_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.trim(F.substring("paper_set", 3, 6))
    outcome = first_failure((F.length(reason) < 5, "REASON_TOO_SHORT"), (~F.col("status").isin("SUBMITTED", "UNDER_REVIEW"), "WRONG_STATE"))
    return domain.evaluations(spark, sf_dir).select("evaluation_id", F.coalesce(outcome, F.lit("OK")).alias("outcome"))


@query(D + "SELECT evaluation_id, examiner_id, CASE WHEN load <= 0 THEN 'EXAMINER_INACTIVE' WHEN status NOT IN ('IN_PROGRESS') THEN 'BOOK_NOT_READY' WHEN quality_status = 'RESCAN_REQUIRED' THEN 'PAGES_NOT_READY' ELSE 'OK' END AS outcome FROM evaluations LEFT JOIN examiners USING (examiner_id)")
def assignment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).join(domain.examiners(spark, sf_dir).select("examiner_id", "load"), "examiner_id", "left")
    outcome = first_failure((F.col("load") <= 0, "EXAMINER_INACTIVE"), (F.col("status") != "IN_PROGRESS", "BOOK_NOT_READY"), (F.col("quality_status") == "RESCAN_REQUIRED", "PAGES_NOT_READY"))
    return rows.select("evaluation_id", "examiner_id", F.coalesce(outcome, F.lit("OK")).alias("outcome"))


@query("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, bool_or(event_type = 'purchase') AS published FROM events GROUP BY 1)
SELECT user_id, CASE WHEN last = 'purchase' THEN 'PUBLISHED' WHEN last = 'error' THEN 'WITHHELD' WHEN published THEN 'PUBLISHED' ELSE 'FINALIZED' END AS status FROM s""")  # fmt: skip
def publication_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish, withhold and release: a released result is published again only if it once was."""
    s = domain.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"), F.bool_or(F.col("event_type") == "purchase").alias("published"))
    last = F.col("l.event_type")
    return s.select("user_id", F.when(last == "purchase", "PUBLISHED").when(last == "error", "WITHHELD").when(F.col("published"), "PUBLISHED").otherwise("FINALIZED").alias("status"))


@query(D + """, p AS (SELECT evaluation_id, question_number, question_id, max_marks, md5(text) AS digest, row_number() OVER (PARTITION BY evaluation_id, question_number ORDER BY marked_at, question_id, moderator_id, amount) AS k FROM marks JOIN questions USING (question_id))
SELECT a.evaluation_id, a.question_number, CASE WHEN a.question_id <> b.question_id AND a.max_marks <> b.max_marks THEN 'MAXIMUM' WHEN a.digest <> b.digest THEN 'TEXT' WHEN a.question_id <> b.question_id THEN 'PAPER' ELSE 'FRESH' END AS staleness
FROM p a JOIN p b ON a.evaluation_id = b.evaluation_id AND a.question_number = b.question_number AND a.k = 1 AND b.k = 2""")  # fmt: skip
def cache_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("evaluation_id", "question_number").orderBy("marked_at", "question_id", "moderator_id", "amount")
    rows = domain.marks(spark, sf_dir).join(domain.questions(spark, sf_dir), "question_id").withColumn("digest", F.md5(F.col("text").cast("binary")))
    now = rows.withColumns({"k": F.row_number().over(w), "q": F.lead("question_id").over(w), "m": F.lead("max_marks").over(w), "d": F.lead("digest").over(w)}).where("k = 1 and q is not null")
    other = F.col("question_id") != F.col("q")
    code = first_failure((other & (F.col("max_marks") != F.col("m")), "MAXIMUM"), (F.col("digest") != F.col("d"), "TEXT"), (other, "PAPER"))
    return now.select("evaluation_id", "question_number", F.coalesce(code, F.lit("FRESH")).alias("staleness"))


@query(_EVIDENCE + f"""SELECT page_id, array_to_string(list_transform(fatal, lambda x: CASE x {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vision.GUIDANCE.items())} END), ' | ') AS guidance FROM v WHERE len(fatal) > 0""")
def operator_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdict(spark, sf_dir).where("fatal <> ''").select("page_id", vision.guidance(F.split("fatal", ",")).alias("guidance"))


@query("""SELECT p_partkey AS question_id, 'Question: ' || p_name || chr(10) || 'Maximum marks: ' || p_size || chr(10) || CASE WHEN p_size > 25 THEN 'Rubric:' || chr(10) || '1. Method (' || p_size // 2 || ')' || chr(10) || '2. Result (' || (p_size - p_size // 2) || ')' ELSE 'No rubric' END AS prompt FROM part""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("max_marks") / 2).cast("int")
    rubric = F.array(F.struct(F.lit("Method").alias("n"), half.alias("m")), F.struct(F.lit("Result").alias("n"), (F.col("max_marks") - half).alias("m")))
    lines = F.array_join(F.transform(rubric, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r.n, F.lit(" ("), r.m.cast("string"), F.lit(")"))), "\n")
    parts = F.concat_ws("\n", F.concat(F.lit("Question: "), F.col("text")), F.concat(F.lit("Maximum marks: "), F.col("max_marks").cast("string")), F.when(F.col("max_marks") > 25, F.concat(F.lit("Rubric:\n"), lines)).otherwise("No rubric"))
    return domain.questions(spark, sf_dir).select("question_id", parts.alias("prompt"))


@query("""WITH w AS (SELECT user_id, event_id, value, lag(value) OVER x AS b, lead(value) OVER x AS a FROM events WINDOW x AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round((2 * value + coalesce(b, 0) + coalesce(a, 0)) / (2 + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN a IS NULL THEN 0 ELSE 1 END), 6) AS smooth FROM w""")  # fmt: skip
def moving_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 1 over a row and its neighbours; at a border, over those that are there."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = domain.table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lag("value").over(w).alias("b"), F.lead("value").over(w).alias("a"))
    there = lambda c: F.when(F.col(c).isNull(), 0).otherwise(1)
    smooth = (2 * F.col("value") + F.coalesce("b", F.lit(0.0)) + F.coalesce("a", F.lit(0.0))) / (2 + there("b") + there("a"))
    return rows.select("user_id", "event_id", F.round(smooth, 6).alias("smooth"))


@query(D + """SELECT evaluation_id, row_number() OVER w AS version, lag(evaluation_id) OVER w AS parent, examiner_id FROM evaluations WINDOW w AS (PARTITION BY examiner_id ORDER BY started_at, evaluation_id)""")
def state_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("examiner_id").orderBy("started_at", "evaluation_id")
    return domain.evaluations(spark, sf_dir).select("evaluation_id", F.row_number().over(w).alias("version"), F.lag("evaluation_id").over(w).alias("parent"), "examiner_id")


@query(f"""WITH {_SCENARIOS}, c AS (SELECT exam, scripts, people, ceil(scripts / (people * 2.0::DOUBLE)) AS days_now, ceil(scripts / ((people + 5) * 2.0::DOUBLE)) AS days_more, ceil(scripts / (people * 1.5::DOUBLE)) AS days_slower FROM s)
SELECT exam, days_now::BIGINT AS days_now, days_more::BIGINT AS days_more, days_slower::BIGINT AS days_slower, (days_now - days_more)::BIGINT AS days_saved, round(scripts / people / 34::DOUBLE, 6) AS fatigue FROM c""")  # fmt: skip
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("scripts"), F.col("people")
    days = {"days_now": F.ceil(s / (n * 2.0)), "days_more": F.ceil(s / ((n + 5) * 2.0)), "days_slower": F.ceil(s / (n * 1.5))}
    rows = scenarios(spark, sf_dir).withColumns({k: v.cast("bigint") for k, v in days.items()})
    return rows.select("exam", *days, (F.col("days_now") - F.col("days_more")).alias("days_saved"), F.round(s / n / 34.0, 6).alias("fatigue"))


@query(D + _GATE + f""", o AS (SELECT examiner_id, status, {_FINAL} AS outcome FROM g)
SELECT exam, count(*) FILTER (outcome = 'OK') AS finalized, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'APPROVED' AND outcome <> 'OK') AS errors,
array_to_string(list_sort(list_distinct(list(outcome) FILTER (outcome <> 'OK'))), ',') AS error_codes FROM o JOIN examiners USING (examiner_id) GROUP BY 1""")  # fmt: skip
def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = domain.examiners(spark, sf_dir).select("examiner_id", "exam")
    rows = domain.evaluations(spark, sf_dir).select("evaluation_id", "examiner_id", "status").join(final_result_gate(spark, sf_dir), "evaluation_id").join(people, "examiner_id")
    ok, approved = F.col("outcome") == "OK", F.col("status") == "APPROVED"
    return rows.groupBy("exam").agg(F.count_if(ok).alias("finalized"), F.count_if(approved).alias("approved"), F.count_if(approved & ~ok).alias("errors"), F.array_join(F.sort_array(F.collect_set(F.when(~ok, F.col("outcome")))), ",").alias("error_codes"))


@query(D + "SELECT evaluation_id, 'APPROVE' AS action, started_at AS decided_at FROM evaluations WHERE status = 'APPROVED' UNION ALL SELECT evaluation_id, 'RETURN', started_at FROM evaluations WHERE status = 'SUBMITTED' AND quality_status = 'RESCAN_REQUIRED'")
def history_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir)
    shape = lambda df, action: df.select("evaluation_id", F.lit(action).alias("action"), F.col("started_at").alias("decided_at"))
    return shape(rows.where("status = 'APPROVED'"), "APPROVE").unionByName(shape(rows.where("status = 'SUBMITTED' and quality_status = 'RESCAN_REQUIRED'"), "RETURN"))


_SUMMARY = " UNION ALL ".join(f"SELECT '{m}' AS measure, count(*) AS n, min({m}) AS low, max({m}) AS high, avg({m}) AS mean, median({m}) AS middle, stddev_pop({m}) AS deviation FROM e" for m in _MEASURES)


@query(_EVIDENCE + f", u AS ({_SUMMARY}) SELECT measure, n, {_r('low high mean middle deviation')} FROM u")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = evidence(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in _MEASURES])).alias("v")).select("v.*")
    s = long.groupBy("measure").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    s = s.join(percentiles(long, ["measure"], "x", {"middle": 0.5}), "measure")
    return rounded(s, "low", "high", "mean", "middle", "deviation")


@query("""WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS b, lag(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
p AS (SELECT conv_id, turn, levenshtein(coalesce(a, ''), b) / greatest(1, length(coalesce(a, ''))) AS raw, levenshtein(lower(coalesce(a, '')), lower(b)) / greatest(1, length(coalesce(a, ''))) AS low FROM t WHERE role = 'assistant')
SELECT CASE WHEN low - raw < -0.01::DOUBLE THEN 'IMPROVED' WHEN low - raw > 0.01::DOUBLE THEN 'DEGRADED' ELSE 'SAME' END AS effect, count(*) AS n, round(avg(raw), 6) AS mean_raw, round(median(low), 6) AS median_low FROM p GROUP BY 1""")  # fmt: skip
def representation_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .statistics import turn_pairs

    return _representations(turn_pairs(spark, sf_dir, folded=True))


@query()
def representation_comparison_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .statistics import turn_pairs

    return _representations(turn_pairs(spark, sf_dir))


def _representations(pairs: DataFrame) -> DataFrame:
    a, b = F.coalesce("ref", F.lit("")), F.col("text")
    n = F.greatest(F.lit(1), F.char_length(a))
    p = pairs.select((edit_distance(a, b) / n).alias("raw"), (edit_distance(F.lower(a), F.lower(b)) / n).alias("low"))
    gap = F.col("low") - F.col("raw")
    effect = F.when(gap < -0.01, "IMPROVED").when(gap > 0.01, "DEGRADED").otherwise("SAME")
    return p.groupBy(effect.alias("effect")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("raw"), 6).alias("mean_raw"), F.round(F.percentile("low", 0.5), 6).alias("median_low"))


@query()
def correction_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.corrected_pages(grids(spark, sf_dir))


@query()
def hypothesis_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.greedy_boxes(boxes(spark, sf_dir), 0.94, 25.0)
    return found.groupBy("page_id", F.col("kept_by").alias("cluster")).agg(F.count(F.lit(1)).alias("n_boxes"), js_round(F.avg("box"), 0).alias("mean_box"))
