"""Queries of scoring, planning, page images and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import js_round
from ..operators import planning, scoring, vision
from ..sources import domain

from .registry import registry
from .statistics import rounded

QUERIES, ORACLE, query = registry()


# Scorers: a mark capped by the question's maximum, and the same less its discount and tax; one to three of them.
_SCORED = """WITH r AS (SELECT l_orderkey AS evaluation_id, l_linenumber AS question_number, l_partkey AS question_id, l_suppkey AS moderator_id, l_linenumber % 3 + 1 AS n, p_size::DOUBLE AS m, least(l_quantity, p_size::DOUBLE) AS s1,
  least(l_quantity, p_size::DOUBLE) * (1::DOUBLE - l_discount) AS s2, least(l_quantity, p_size::DOUBLE) * (1::DOUBLE - l_tax) AS s3, 1::DOUBLE - l_discount AS c1, 1::DOUBLE - l_tax AS c2, l_returnflag = 'R' AS flag FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT *, list_sort(([s1, s2, s3])[1:n]) AS s, ([c1, c2, 0.9::DOUBLE])[1:n] AS c FROM r),
g AS (SELECT *, s[n] - s[1] AS range, CASE WHEN m > 0 THEN (s[n] - s[1]) / m ELSE 0 END AS gap, m * 0.18::DOUBLE AS t, ((0::DOUBLE + c[1]) + CASE WHEN n > 1 THEN c[2] ELSE 0 END + CASE WHEN n > 2 THEN c[3] ELSE 0 END) / n AS mean FROM q),
x AS (SELECT *, least(greatest(1 - gap, 0::DOUBLE), 1::DOUBLE) AS agreement, n = 3 AND ((s[2] - s[1] > t AND s[3] - s[2] <= t)) AS upper, n = 3 AND ((s[3] - s[2] > t AND s[2] - s[1] <= t)) AS lower FROM g),
k AS (SELECT *, CASE WHEN n = 1 THEN s[1] WHEN range = 0 THEN s[1] WHEN n = 2 THEN (s[1] + s[2]) / 2 WHEN upper THEN (s[2] + s[3]) / 2 WHEN lower THEN (s[1] + s[2]) / 2 ELSE s[2] END AS marks,
  CASE WHEN n = 1 THEN 'SINGLE_FALLBACK' WHEN range = 0 THEN 'UNANIMOUS' WHEN upper OR lower THEN 'MAJORITY_QUORUM' ELSE 'WEIGHTED_MEDIAN' END AS strategy,
  CASE WHEN agreement >= 0.9::DOUBLE THEN least(0.98::DOUBLE, mean + 0.08::DOUBLE) WHEN agreement < 0.75::DOUBLE THEN greatest(0.4::DOUBLE, mean - 0.2::DOUBLE) ELSE mean END AS confidence FROM x),
o AS (SELECT evaluation_id, question_number, question_id, moderator_id, CASE WHEN n = 1 THEN s1 ELSE least(greatest(floor(marks * 10 + 0.5::DOUBLE) / 10, 0::DOUBLE), m) END AS marks, strategy, CASE WHEN n = 1 THEN 0::DOUBLE ELSE floor(range * 10 + 0.5::DOUBLE) / 10 END AS score_range, CASE WHEN n = 1 THEN 1::DOUBLE ELSE floor(agreement * 100 + 0.5::DOUBLE) / 100 END AS agreement,
  CASE WHEN n = 1 THEN c1 ELSE floor(confidence * 100 + 0.5::DOUBLE) / 100 END AS confidence, CASE WHEN n = 1 THEN flag ELSE (flag OR gap > 0.15::DOUBLE OR confidence < 0.82::DOUBLE) END AS needs_review FROM k)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = domain.table(spark, sf_dir, "lineitem"), domain.table(spark, sf_dir, "part")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"])
    m, n = F.col("p_size").cast("double"), (F.col("l_linenumber") % 3 + 1).cast("int")
    s1 = F.least("l_quantity", m)
    return rows.select(
        F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").alias("question_number"), F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("moderator_id"), m.alias("maximum"),
        F.slice(F.array(s1, s1 * (1 - F.col("l_discount")), s1 * (1 - F.col("l_tax"))), F.lit(1), n).alias("scores"),
        F.slice(F.array(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.lit(0.9)), F.lit(1), n).alias("confidences"), F.array(F.col("l_returnflag") == "R").alias("reviews"),
    )


_KEYS = ("evaluation_id", "question_number", "question_id", "moderator_id")


@query(_SCORED + "SELECT * FROM o")
def consensus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    agreed = scoring.consensus(F.col("scores"), F.col("confidences"), F.col("reviews"), F.col("maximum"))
    return scored(spark, sf_dir).select(*_KEYS, agreed.alias("c")).select(*_KEYS, "c.*")


_HUNDREDTHS = "floor({} * 100 + 0.5::DOUBLE) / 100"
_TEXT = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"


@query(f"""WITH r AS (SELECT l_orderkey AS evaluation_id, l_linenumber AS question_number, l_partkey AS question_id, l_suppkey AS moderator_id, l_linenumber % 3 + 1 AS n, p_size::DOUBLE AS m, floor(p_size * 0.6::DOUBLE + 0.5::DOUBLE) AS a, {_HUNDREDTHS.format("least(l_quantity, p_size::DOUBLE)")} AS s1,
  {_HUNDREDTHS.format("least(l_quantity, p_size::DOUBLE) * (1::DOUBLE - l_discount)")} AS s2, {_HUNDREDTHS.format("least(l_quantity, p_size::DOUBLE) * (1::DOUBLE - l_tax)")} AS s3, 1::DOUBLE - l_discount AS c1, 1::DOUBLE - l_tax AS c2, l_returnflag, l_linestatus, l_returnflag = 'R' AS flag FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT *, ([s1, s2, s3])[1:n] AS given, list_sort(([s1, s2, s3])[1:n]) AS s, ([c1, c2, 0.9::DOUBLE])[1:n] AS c FROM r),
g AS (SELECT *, s[n] - s[1] AS range, CASE WHEN m > 0 THEN (s[n] - s[1]) / m ELSE 0 END AS gap, m * 0.18::DOUBLE AS t FROM q),
k AS (SELECT *, CASE WHEN n = 1 THEN s1 ELSE least(greatest(floor(CASE WHEN range = 0 THEN s[1] WHEN n = 2 THEN (s[1] + s[2]) / 2 WHEN s[2] - s[1] > t AND s[3] - s[2] <= t THEN (s[2] + s[3]) / 2 WHEN s[3] - s[2] > t AND s[2] - s[1] <= t THEN (s[1] + s[2]) / 2 ELSE s[2] END * 10 + 0.5::DOUBLE) / 10, 0::DOUBLE), m) END AS marks FROM g)
SELECT evaluation_id, question_number, question_id, moderator_id, marks, s[1] * 0.5::DOUBLE AS low, s[n] AS high,
  CASE WHEN n = 1 THEN s1 * 0.5::DOUBLE ELSE least(a, floor((0::DOUBLE + s1 * 0.5::DOUBLE + CASE WHEN n > 1 THEN s2 * 0.5::DOUBLE ELSE 0 END + CASE WHEN n > 2 THEN s3 * 0.5::DOUBLE ELSE 0 END) / n * 10 + 0.5::DOUBLE) / 10) END AS method_marks,
  CASE WHEN n = 1 THEN s1 * 0.25::DOUBLE ELSE least(m - a, floor((0::DOUBLE + s1 * 0.25::DOUBLE + CASE WHEN n > 2 THEN s3 * 0.25::DOUBLE ELSE 0 END) / CASE WHEN n > 2 THEN 2 ELSE 1 END * 10 + 0.5::DOUBLE) / 10) END AS result_marks,
  CASE WHEN n = 1 THEN CASE WHEN l_linestatus = 'F' THEN 'steps shown' ELSE ' ' END WHEN l_linestatus = 'F' THEN 'steps shown' ELSE 'seen by 2' END AS method_evidence, CASE WHEN n = 1 THEN '' ELSE '{scoring.NO_EVIDENCE}' END AS result_evidence,
  array_to_string(CASE WHEN n = 1 OR l_returnflag = 'b' THEN [l_returnflag] ELSE [l_returnflag, 'b'] END, ',') AS missing, CASE WHEN n = 1 THEN 'model-1' ELSE 'Ensemble (' || array_to_string((['model-1', 'model-2', 'model-3'])[1:n], ' + ') || ')' END AS model,
  CASE WHEN n = 1 THEN 'as marked' ELSE 'Consensus score: ' || {_TEXT.format("marks")} || '/' || m::BIGINT || ' across ' || n || ' parallel models.' || CASE WHEN gap > 0.15::DOUBLE THEN ' ⚠ Divergence notice: Models varied by ' || printf('%.1f', floor(range * 10 + 0.5::DOUBLE) / 10) || ' marks (' || floor(gap * 100 + 0.5::DOUBLE)::BIGINT || '%). Examiner inspection recommended.' ELSE '' END
    || chr(10) || array_to_string(list_transform(given, lambda x, i: '[model-' || i || ': ' || {_TEXT.format("x")} || '/' || m::BIGINT || '] as marked'), chr(10)) END AS summary FROM k""")  # fmt: skip
def consensus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records that scorers agree on: range, criteria, concepts, summary and names. The second scorer judges one criterion only."""
    line, part = domain.table(spark, sf_dir, "lineitem"), domain.table(spark, sf_dir, "part")
    m, n = F.col("p_size").cast("double"), (F.col("l_linenumber") % 3 + 1).cast("int")
    a = F.floor(m * 0.6 + 0.5).cast("double")
    s1 = F.least("l_quantity", m)

    def result(i: int, marks: Column, confidence: Column) -> Column:
        marks = js_round(marks, 2)
        method = F.struct(F.lit("Method").alias("name"), a.alias("max_marks"), (marks * 0.5).alias("awarded"), (F.when(F.col("l_linestatus") == "F", "steps shown").otherwise(" ") if i == 1 else F.lit(f"seen by {i}")).alias("evidence"))
        value = F.struct(F.lit("Result").alias("name"), (m - a).alias("max_marks"), (marks * 0.25).alias("awarded"), F.lit("").alias("evidence"))
        parts = (F.lit(f"model-{i}"), marks, marks * 0.5, marks, confidence, F.col("l_returnflag") == "R", F.array(method) if i == 2 else F.array(method, value), F.array("l_returnflag") if i == 1 else F.array(F.lit("b"), "l_returnflag"), F.lit("as marked"))
        return F.struct(*[v.alias(c) for c, v in zip(("model", "marks", "low", "high", "confidence", "review", "criteria", "missing", "summary"), parts, strict=True)]).cast(scoring.RESULT)

    results = F.array(result(1, s1, 1 - F.col("l_discount")), result(2, s1 * (1 - F.col("l_discount")), 1 - F.col("l_tax")), result(3, s1 * (1 - F.col("l_tax")), F.lit(0.9)))
    rows = line.join(part, line["l_partkey"] == part["p_partkey"])
    keys = [F.col(c).alias(k) for c, k in zip(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), _KEYS, strict=True)]
    r = scoring.consensus_records(rows.select(*keys, F.slice(results, F.lit(1), n).alias("results"), m.alias("m")), "results", "m", "r")
    at = lambda i, c: F.get("r.criteria", F.lit(i))[c]
    return r.select(*_KEYS, "r.marks", "r.low", "r.high", at(0, "awarded").alias("method_marks"), at(1, "awarded").alias("result_marks"), at(0, "evidence").alias("method_evidence"), at(1, "evidence").alias("result_evidence"), F.array_join("r.missing", ",").alias("missing"), "r.model", "r.summary")


@query(_SCORED + "SELECT strategy, CASE WHEN confidence >= 0.85::DOUBLE THEN 'HIGH' WHEN confidence >= 0.70::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS n, count(*) FILTER (needs_review) AS to_review FROM o GROUP BY ALL")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus_scores(spark, sf_dir).groupBy("strategy", scoring.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_review").alias("to_review"))


@query("""WITH r AS (SELECT l_orderkey AS evaluation_id, l_linenumber AS question_number, l_partkey AS question_id, l_quantity * (1::DOUBLE - 2::DOUBLE * l_discount) AS low, l_quantity * (1::DOUBLE - l_tax) AS suggested, l_quantity AS high, p_size::DOUBLE AS m, 1.05::DOUBLE - l_discount AS c, l_quantity * 0.9::DOUBLE AS crit FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT evaluation_id, question_number, question_id, CASE WHEN low < 0 THEN 'NEGATIVE_MINIMUM' WHEN low > suggested THEN 'MINIMUM_ABOVE_SUGGESTED' WHEN suggested > high THEN 'SUGGESTED_ABOVE_MAXIMUM' WHEN high > m THEN 'ABOVE_QUESTION_MAXIMUM' WHEN c < 0 OR c > 1 THEN 'CONFIDENCE_OUT_OF_RANGE' WHEN crit > m + 0.01::DOUBLE THEN 'CRITERIA_ABOVE_MAXIMUM' ELSE 'OK' END AS violation FROM r""")  # fmt: skip
def ai_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = domain.table(spark, sf_dir, "lineitem"), domain.table(spark, sf_dir, "part")
    q, m = F.col("l_quantity"), F.col("p_size").cast("double")
    code = scoring.constraint_violation(q * (1 - 2 * F.col("l_discount")), q * (1 - F.col("l_tax")), q, m, 1.05 - F.col("l_discount"), q * 0.9)
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").alias("question_number"), F.col("l_partkey").alias("question_id"), F.coalesce(code, F.lit("OK")).alias("violation"))


@query("""WITH r AS (SELECT p_partkey AS question_id, p_size::DOUBLE AS m, floor(p_size * 0.6::DOUBLE + 0.5::DOUBLE) AS a FROM part)
SELECT question_id, a AS first_max, m - a AS second_max, least(greatest(floor(a * 0.85::DOUBLE * 2 + 0.5::DOUBLE) / 2, 0::DOUBLE), a) AS first_marks, least(greatest(floor((m - a) * 0.75::DOUBLE * 2 + 0.5::DOUBLE) / 2, 0::DOUBLE), m - a) AS second_marks FROM r""")  # fmt: skip
def analytical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.questions(spark, sf_dir).withColumn("r", scoring.default_rubric(F.col("max_marks").cast("double"))).withColumn("p", scoring.placeholder_marks(F.col("r")))
    return rows.select("question_id", F.get("r", F.lit(0)).alias("first_max"), F.get("r", F.lit(1)).alias("second_max"), F.get("p", F.lit(0)).alias("first_marks"), F.get("p", F.lit(1)).alias("second_marks"))


@query("SELECT l_orderkey AS evaluation_id, count(*) FILTER (l_returnflag = 'N') AS failed, count(*) FILTER (l_returnflag = 'R') AS review, CASE WHEN count(*) FILTER (l_returnflag IN ('N', 'R')) > 0 THEN 'COMPLETED_WITH_REVIEW' ELSE 'COMPLETED' END AS status FROM lineitem GROUP BY 1")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("mark_status")
    by = domain.marks(spark, sf_dir).groupBy("evaluation_id").agg(F.count_if(s == "NOT_ATTEMPTED").alias("failed"), F.count_if(s == "FLAGGED").alias("review"))
    return by.withColumn("status", scoring.job_status(F.col("failed"), F.col("review")))


@query("""WITH books AS (SELECT o_orderkey AS book_id, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'O'),
slots AS (SELECT examiner_id, row_number() OVER (ORDER BY level, examiner_id) AS rank FROM (SELECT c_custkey AS examiner_id, unnest(range(c_custkey % 7, c_custkey % 7 + 40)) AS level FROM customer))
SELECT book_id, examiner_id FROM books JOIN slots USING (rank)""")  # fmt: skip
def auto_assign_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = domain.evaluations(spark, sf_dir).where("status = 'IN_PROGRESS'").select(F.col("evaluation_id").alias("book_id"))
    people = domain.examiners(spark, sf_dir).select("examiner_id", (F.col("examiner_id") % 7).alias("load"))
    return planning.assign_least_loaded(books, people)


_SCENARIOS = "s AS (SELECT c_mktsegment AS exam, count(*) AS scripts, count(DISTINCT c_custkey) AS people, min(o_orderdate)::DATE AS start FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.evaluations(spark, sf_dir).join(domain.examiners(spark, sf_dir).select("examiner_id", "exam"), "examiner_id")
    return rows.groupBy("exam").agg(F.count(F.lit(1)).alias("scripts"), F.count_distinct("examiner_id").alias("people"), F.min("started_at").cast("date").alias("start"))


def _days(least: int) -> Column:
    """All working days of an exam, and as many as the SQL has at least."""
    return F.greatest(F.lit(least), planning.total_working_days(F.col("scripts"), F.col("people"), F.lit(30), F.floor(F.col("people") / 4)))


@query(f"""WITH {_SCENARIOS}, d AS (SELECT exam, scripts, people, unnest(range(0, 31)) AS day FROM s), m AS (SELECT *, least(scripts, day * people) AS marked, ceil(least(scripts, day * people) * 30 / 100.0::DOUBLE) AS sent FROM d)
SELECT exam, day::INT AS day, marked, moderated::BIGINT AS moderated, greatest(0, sent - moderated)::BIGINT AS backlog FROM (SELECT *, CASE WHEN day < 2 THEN 0 ELSE least(sent, (day - 1) * (people // 4)) END AS moderated FROM m)""")  # fmt: skip
def timeline_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    moderation = F.floor(F.col("people") / 4)
    return planning.timeline(spark, _days(30), F.col("scripts"), F.col("people"), F.lit(30), moderation, scenarios(spark, sf_dir)).select("exam", "day", "marked", "moderated", "backlog")


@query(f"""WITH {_SCENARIOS}, c AS (SELECT *, (people // 4) / (people * 0.3::DOUBLE) AS ratio, ceil(scripts / people) AS days, scripts / people AS pace FROM s)
SELECT exam, round(ratio, 6) AS ratio, days::BIGINT AS days, CASE WHEN ratio < 0.95::DOUBLE THEN 'MODERATION' WHEN days > 22 THEN 'EVALUATION' WHEN pace > 34 THEN 'LOAD' ELSE 'NONE' END AS bottleneck FROM c""")  # fmt: skip
def timeline_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenarios(spark, sf_dir).withColumns({"ratio": F.floor(F.col("people") / 4) / (F.col("people") * 0.3), "days": F.ceil(F.col("scripts") / F.col("people")), "pace": F.col("scripts") / F.col("people")})
    return s.select("exam", F.round("ratio", 6).alias("ratio"), F.col("days").cast("bigint").alias("days"), planning.bottleneck(F.col("ratio"), F.col("days"), F.col("pace")).alias("bottleneck"))


@query(f"""WITH {_SCENARIOS}, d AS (SELECT exam, start + unnest(range(1, 51))::INT AS working_date FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY working_date) AS number FROM d WHERE isodow(working_date) <= 5)
SELECT exam, number::INT AS number, working_date::DATE AS working_date FROM n WHERE number <= 20""")  # fmt: skip
def timeline_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenarios(spark, sf_dir).select("exam", F.posexplode(planning.working_days(F.col("start"), _days(20))).alias("at", "working_date"))
    return rows.select("exam", (F.col("at") + 1).alias("number"), "working_date")


# Page images: the 64 values as an 8 x 8 grid of grey levels.
_GRID = "g AS (SELECT vec_id AS page_id, label, list_transform(embedding, lambda x: (x::DOUBLE + 0.6::DOUBLE) * 200::DOUBLE) AS g FROM embeddings)"
_INNER = [(y, x) for y in range(1, 7) for x in range(1, 7)]
_LAP = "[" + ", ".join(f"g[{(y - 1) * 8 + x + 1}] + g[{(y + 1) * 8 + x + 1}] + g[{y * 8 + x}] + g[{y * 8 + x + 2}] - 4 * g[{y * 8 + x + 1}]" for y, x in _INNER) + "]"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), "label", F.transform("embedding", lambda x: (x.cast("double") + 0.6) * 200).alias("grid"))


@query(f"WITH {_GRID}, l AS (SELECT page_id, list_aggregate({_LAP}, 'var_pop') AS v FROM g) SELECT page_id, round(v, 4) AS variance, round(v / 1000, 3) < 0.055::DOUBLE AS soft FROM l")
def grid_laplacian_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = grids(spark, sf_dir).select("page_id", vision.laplacian_variance(F.col("grid")).alias("v"))
    return v.select("page_id", F.round("v", 4).alias("variance"), (F.round(F.col("v") / 1000, 3) < 0.055).alias("soft"))


@query(f"""WITH {_GRID}, l AS (SELECT page_id, list_aggregate({_LAP}, 'var_pop') / 100 AS v FROM g)
SELECT page_id, floor(CASE WHEN v < 55 THEN least(greatest(50 * v / 55, 5::DOUBLE), 54.9::DOUBLE) ELSE 55 + 44.5::DOUBLE * least(1::DOUBLE, (v - 55) / 945) END + 0.5::DOUBLE) AS score FROM l""")  # fmt: skip
def grid_sharpness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = grids(spark, sf_dir).select("page_id", (vision.laplacian_variance(F.col("grid")) / 100).alias("v"))
    raw = F.when(F.col("v") < 55, F.least(F.greatest(50 * F.col("v") / 55, F.lit(5.0)), F.lit(54.9))).otherwise(55 + 44.5 * F.least(F.lit(1.0), (F.col("v") - 55) / 945))
    return v.select("page_id", F.floor(raw + 0.5).cast("double").alias("score"))


@query(f"WITH {_GRID}, p AS (SELECT page_id, g, list_aggregate(g, 'quantile_cont', 0.01) AS a, list_aggregate(g, 'quantile_cont', 0.99) AS b FROM g) SELECT page_id, round(list_sum(list_transform(g, lambda x: CASE WHEN b - a < 1e-9 THEN x ELSE least(greatest((x - a) * 255.0::DOUBLE / (b - a), 0::DOUBLE), 255::DOUBLE) END)) / 64, 4) AS mean_level, round(a, 4) AS low, round(b, 4) AS high FROM p")
def grid_contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("grid")
    rows = grids(spark, sf_dir).withColumns({"low": vision.percentile_of(g, 0.01), "high": vision.percentile_of(g, 0.99)})
    return rows.select("page_id", F.round(vision.mean(vision.contrast_stretch(g, F.col("low"), F.col("high"))), 4).alias("mean_level"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_REGIONS = "[" + ", ".join("list_aggregate([" + ", ".join(f"g[{(cy * 2 + y) * 8 + cx * 2 + x + 1}]" for y in range(2) for x in range(2)) + "], 'quantile_cont', 0.85)" for cy in range(4) for cx in range(4)) + "]"


@query(f"WITH {_GRID}, r AS (SELECT page_id, {_REGIONS} AS r FROM g) SELECT page_id, round(list_min(r) / list_max(r), 4) AS background_ratio, round(list_max(r) - list_min(r), 4) AS deficit, round(list_aggregate(r, 'stddev_pop'), 4) AS deviation FROM r")
def grid_regional_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grids(spark, sf_dir).select("page_id", vision.regional_background(F.col("grid")).alias("r"))
    return r.select("page_id", F.round(F.array_min("r") / F.array_max("r"), 4).alias("background_ratio"), F.round(F.array_max("r") - F.array_min("r"), 4).alias("deficit"), F.round(F.sqrt(vision.variance(F.col("r"))), 4).alias("deviation"))


_EVIDENCE = f"""WITH {_GRID}, r AS (SELECT page_id, label, {_REGIONS} AS r, list_aggregate(g, 'quantile_cont', 0.9) - list_aggregate(g, 'quantile_cont', 0.1) AS delta, list_aggregate(g, 'quantile_cont', 0.5) AS mid, list_aggregate({_LAP}, 'var_pop') AS lap, g FROM g),
e AS (SELECT page_id, round(lap / 20, 3) AS acutance, round(delta, 3) AS stroke_contrast, round(len(list_filter(g, lambda x: abs(x - mid) < 25)) / 64::DOUBLE, 3) AS faint_fraction, round(list_min(r) / list_max(r), 3) AS background_ratio, round(list_max(r) - list_min(r), 3) AS background_deficit, (label * 2)::DOUBLE AS skew FROM r),
d AS (SELECT *, list_filter([CASE WHEN acutance < 120 THEN 'FATAL_OPTICAL_DEFOCUS' END, CASE WHEN stroke_contrast < 18 OR faint_fraction > 0.60::DOUBLE THEN 'FATAL_INK_LOSS' END], lambda x: x IS NOT NULL) AS fatal,
  list_filter([CASE WHEN acutance < 220 THEN 'Blur' END, CASE WHEN stroke_contrast < 35 THEN 'Contrast' END, CASE WHEN faint_fraction > 0.35::DOUBLE THEN 'Faint strokes' END, CASE WHEN skew > 7 THEN 'Skew' END, CASE WHEN background_ratio < 0.65::DOUBLE OR background_deficit > 45 THEN 'Shadow' END], lambda x: x IS NOT NULL) AS risks FROM e),
v AS (SELECT *, CASE WHEN len(fatal) > 0 THEN 'UNUSABLE' WHEN len(risks) = 0 THEN 'GOOD' WHEN len(risks) = 1 AND list_contains(risks, 'Shadow') THEN 'ACCEPTABLE' WHEN len(risks) <= 2 AND NOT list_contains(risks, 'Blur') AND NOT list_contains(risks, 'Contrast') THEN 'ACCEPTABLE' ELSE 'BORDERLINE' END AS verdict FROM d)
"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("grid")
    rows = grids(spark, sf_dir).withColumns({"r": vision.regional_background(g), "mid": vision.percentile_of(g, 0.5)})
    faint = F.size(F.filter("grid", lambda x: F.abs(x - F.col("mid")) < 25)) / 64.0
    measures = {
        "acutance": F.round(vision.laplacian_variance(g) / 20, 3), "stroke_contrast": F.round(vision.percentile_of(g, 0.9) - vision.percentile_of(g, 0.1), 3), "faint_fraction": F.round(faint, 3),
        "background_ratio": F.round(F.array_min("r") / F.array_max("r"), 3), "background_deficit": F.round(F.array_max("r") - F.array_min("r"), 3), "skew": (F.col("label") * 2).cast("double"),
    }
    # Through explode no filter is pushed down, where it would repeat the sorts above for each use.
    return rows.select("page_id", F.explode(F.array(F.struct(*[v.alias(k) for k, v in measures.items()]))).alias("e")).select("page_id", "e.*")


_MEASURES = ("acutance", "stroke_contrast", "faint_fraction", "background_ratio", "background_deficit", "skew")


@query(_EVIDENCE + "SELECT page_id, array_to_string(fatal, ',') AS fatal, array_to_string(risks, ',') AS risks, verdict FROM v")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {c: F.col(c) for c in _MEASURES}
    rows = evidence(spark, sf_dir).withColumns({"fatal": vision.fatal_defects(e), "risks": vision.risk_factors(e)})
    return rows.select("page_id", F.array_join("fatal", ",").alias("fatal"), F.array_join("risks", ",").alias("risks"), vision.verdict(F.col("fatal"), F.col("risks")).alias("verdict"))


@query(_EVIDENCE + "SELECT page_id, CASE WHEN len(fatal) > 0 THEN 'RESCAN' WHEN faint_fraction > 0.5::DOUBLE THEN 'HUMAN_REVIEW' WHEN verdict = 'GOOD' THEN 'CONTINUE' WHEN verdict = 'ACCEPTABLE' AND len(risks) <= 1 THEN 'CONTINUE' ELSE 'HUMAN_REVIEW' END AS decision FROM v")
def rescan_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {c: F.col(c) for c in _MEASURES}
    rows = evidence(spark, sf_dir).withColumns({"fatal": vision.fatal_defects(e), "risks": vision.risk_factors(e)})
    return rows.select("page_id", vision.rescan_decision(F.col("fatal"), F.col("risks"), F.col("faint_fraction") > 0.5).alias("decision"))


@query(_EVIDENCE + "SELECT page_id, CASE WHEN acutance < 35 OR (acutance < 40 AND acutance < 120) OR skew > 16 OR background_ratio < 0.3::DOUBLE THEN 'RESCAN_REQUIRED' ELSE 'PASSED' END AS usability, CASE WHEN skew > 16 THEN 'ORIENTATION_AMBIGUOUS' WHEN faint_fraction > 0.15::DOUBLE THEN 'NOT_READY' WHEN skew > 6 THEN 'CONDITIONAL' WHEN stroke_contrast / 20 >= 2.2::DOUBLE AND faint_fraction < 0.08::DOUBLE THEN 'HTR_READY' ELSE 'CONDITIONAL' END AS readiness FROM e")
def readiness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, s, f = F.col("acutance"), F.col("skew"), F.col("faint_fraction")
    return evidence(spark, sf_dir).select("page_id", vision.usability(a, a, a < 120, s > 16, F.col("background_ratio") >= 0.3).alias("usability"), vision.readiness(s > 16, f, s > 6, F.col("stroke_contrast") / 20).alias("readiness"))


@query("SELECT doc_id, CASE WHEN quality = 0 OR text LIKE '%|%' THEN 'DISQUALIFIED' WHEN n_chars % 100 / 100.0::DOUBLE < 0.90::DOUBLE OR n_chars < 15 THEN 'AUDIT_ONLY' ELSE 'QUALIFIED' END AS eligibility FROM documents JOIN labels USING (doc_id)")
def feedback_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").join(domain.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select("doc_id", vision.feedback_eligibility(F.col("quality") == 0, F.contains("text", F.lit("|")), F.col("n_chars") % 100 / 100.0, F.col("n_chars")).alias("eligibility"))


@query("""WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS box, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 20 AS x1, l_discount * 100 + 5 + l_tax * 50 AS y1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
p AS (SELECT a.page_id, a.k AS first_box, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b a JOIN b ON a.page_id = b.page_id AND b.k = a.k + 1)
SELECT page_id, first_box::INT AS first_box, round(i / (s - i + 1e-6::DOUBLE), 6) AS iou FROM p""")  # fmt: skip
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("box", "l_partkey", "l_suppkey", "x0")
    line = domain.table(spark, sf_dir, "lineitem")
    b = line.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("box"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 20).alias("x1"), (F.col("l_discount") * 100 + 5 + F.col("l_tax") * 50).alias("y1"))
    corners = ("x0", "y0", "x1", "y1")
    pairs = b.withColumns({"first_box": F.row_number().over(w), **{f"n{c}": F.lead(c).over(w) for c in corners}}).where("nx0 is not null")
    return pairs.select("page_id", "first_box", F.round(vision.box_iou([F.col(c) for c in corners], [F.col(f"n{c}") for c in corners]), 6).alias("iou"))


@query()
def grid_kernel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vision.grid_kernels(grids(spark, sf_dir)), "edge_spread")


