"""Queries of statistics and of text mapping, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import significance
from ..operators import statistics as ops
from ..operators import text as tx
from ..sources import domain
from ..sources.domain import SQL as D
from .events import folder
from .registry import registry

QUERIES, ORACLE, query = registry()


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Sums of doubles differ in the last places with the order of rows."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _r(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events)
SELECT event_type, round(CASE WHEN count(*) > 1 AND sum(value) <> 0 THEN abs(2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*)) ELSE 0 END, 6) AS gini FROM r GROUP BY 1""")  # fmt: skip
def distribution_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.gini(events(spark, sf_dir), ["event_type"], "value"), "gini")


@query(f"""WITH s AS (SELECT user_id, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS low, max(x) AS high, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr,
CASE WHEN avg(x) <> 0 THEN stddev_pop(x) / avg(x) ELSE 0 END AS cov FROM (SELECT user_id, nullif(value, 0) AS x FROM events) GROUP BY 1) SELECT user_id, {_r('mean std low high p25 p75 iqr cov')} FROM s""")  # fmt: skip
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.spread(events(spark, sf_dir), ["user_id"], "value"), "mean", "std", "low", "high", "p25", "p75", "iqr", "cov")


@query("""SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.15), 6) AS p15, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.85), 6) AS p85,
round(quantile_cont(value, 0.99), 6) AS p99, round(median(value), 6) AS middle FROM events GROUP BY 1""")  # fmt: skip
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"p1": 0.01, "p15": 0.15, "p50": 0.5, "p85": 0.85, "p99": 0.99, "middle": 0.5}
    return rounded(ops.percentiles(events(spark, sf_dir), ["event_type"], "value", wanted), *wanted)


@query("""WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT user_id, round(1.4826::DOUBLE * median(abs(value - m)), 6) AS sigma FROM events JOIN m USING (user_id) GROUP BY 1""")
def mad_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.mad_sigma(events(spark, sf_dir), ["user_id"], "value"), "sigma")


@query("""WITH t AS (SELECT event_type, avg(value) AS t FROM events GROUP BY 1), s AS (SELECT event_type, avg(CASE WHEN value < t THEN 1.0::DOUBLE ELSE 0 END) AS w0, avg(CASE WHEN value < t THEN value END) AS m0, avg(CASE WHEN value >= t THEN value END) AS m1, var_pop(value) AS v
FROM events JOIN t USING (event_type) GROUP BY 1) SELECT event_type, round(least(1.0::DOUBLE, coalesce(CASE WHEN v > 1e-12 THEN w0 * (1 - w0) * (m0 - m1) * (m0 - m1) / v END, 0.5::DOUBLE)), 6) AS eta FROM s""")  # fmt: skip
def otsu_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    cut = rows.groupBy("event_type").agg(F.avg("value").alias("cut"))
    return rounded(ops.otsu_eta(rows.join(cut, "event_type"), ["event_type"], "value", "cut"), "eta")


_MEASURES = ("marks", "amount", "max_marks", "discount", "tax")
_MEASURED = "m AS (SELECT l_orderkey AS evaluation_id, l_linenumber AS question_number, l_partkey AS question_id, l_returnflag AS flag, l_quantity::DOUBLE AS marks, l_extendedprice AS amount, p_size::DOUBLE AS max_marks, l_discount AS discount, l_tax AS tax FROM lineitem JOIN part ON l_partkey = p_partkey)"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = domain.table(spark, sf_dir, "lineitem"), domain.table(spark, sf_dir, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").alias("question_number"), F.col("l_partkey").alias("question_id"), F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").cast("double").alias("marks"), F.col("l_extendedprice").alias("amount"), F.col("p_size").cast("double").alias("max_marks"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def _pearson(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 2 AND stddev_pop({x}) * stddev_pop({y}) > 1e-9 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) ELSE 0 END"


@query(f"WITH {_MEASURED} SELECT flag, round({_pearson('marks', 'amount')}, 6) AS r, count(*) AS n FROM m GROUP BY 1")
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.expr import pearson

    return rounded(measured(spark, sf_dir).groupBy("flag").agg(pearson("marks", "amount").alias("r"), F.count(F.lit(1)).alias("n")), "r")


@query(f"""WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)::DOUBLE AS a, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id)::DOUBLE AS b FROM events)
SELECT event_type, round({_pearson('a', 'b')}, 6) AS rho FROM r GROUP BY 1""")  # fmt: skip
def spearman_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.ordinal_ranks(ops.ordinal_ranks(events(spark, sf_dir), ["event_type"], "value", "event_id", "a"), ["event_type"], "user_id", "event_id", "b")
    return rounded(ops.correlation(rows, ["event_type"], "a", "b", "rho"), "rho")


@query(f"""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS a,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0::DOUBLE AS b FROM events) SELECT event_type, round({_pearson('a', 'b')}, 6) AS rho FROM r GROUP BY 1""")  # fmt: skip
def spearman_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.average_ranks(ops.average_ranks(events(spark, sf_dir), ["event_type"], "value", "a"), ["event_type"], "user_id", "b")
    return rounded(ops.correlation(rows, ["event_type"], "a", "b", "rho"), "rho")


_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i:]]
_MATRIX = f"WITH {_MEASURED}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_pearson(a, b)}, 6) AS r FROM m" for a, b in _PAIRS) + ")"


@query(_MATRIX + " SELECT a, b, r FROM c")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.correlation_matrix(measured(spark, sf_dir), list(_MEASURES)), "r")


@query(_MATRIX + " SELECT a, b, r, CASE WHEN abs(r) >= 0.85 THEN 'REDUNDANT' WHEN abs(r) <= 0.15 THEN 'ORTHOGONAL' ELSE 'RELATED' END AS kind FROM c WHERE a <> b ORDER BY abs(r) DESC, a, b LIMIT 10")
def redundant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.abs("r")
    kind = F.when(r >= 0.85, "REDUNDANT").when(r <= 0.15, "ORTHOGONAL").otherwise("RELATED")
    return correlation_matrix(spark, sf_dir).where("a <> b").withColumn("kind", kind).orderBy(r.desc(), "a", "b").limit(10)


@query("""WITH e AS (SELECT user_id, event_id, value > 30 AS active, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT user_id, event_id, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e WHERE active)
SELECT user_id, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS run_length FROM g GROUP BY user_id, run""")  # fmt: skip
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.runs(events(spark, sf_dir), ["user_id"], "event_id", F.col("value") > 30)


_PEAKS = """WITH n AS (SELECT user_id, event_id, value, lag(value) OVER w AS b, lead(value) OVER w AS a, avg(value) OVER (PARTITION BY user_id) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT user_id, event_id, value, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS pitch FROM n WHERE value > b AND value > a AND value > m)
"""


@query(_PEAKS + "SELECT * FROM p")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peaks(events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query(_PEAKS + "SELECT user_id, count(*) AS n_peaks, median(pitch)::DOUBLE AS line_pitch FROM p GROUP BY 1")
def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_peaks(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_peaks"), F.percentile("pitch", 0.5).alias("line_pitch"))


# DuckDB's levenshtein counts bytes; letters beyond ASCII are folded to one sign before either engine compares. Queries named ``_unicode`` compare whole texts.
_TURNS = """WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text, lag(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
n AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(ref, ''), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS b FROM t WHERE role = 'assistant')
"""


def turn_pairs(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    """Each assistant's turn and the turn before; ``folded``: as the SQL has them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "?") if folded else F.col("text")
    pairs = domain.table(spark, sf_dir, "conversations").withColumn("text", text).withColumn("ref", F.lag("text").over(w)).where("role = 'assistant'").select("conv_id", "turn", "ref", "text")
    # An edit distance costs far more than its texts to move: dealing pairs spreads few bytes, and long conversations, over all tasks.
    return pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")


def _written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = folder(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


_TELEMETRY = ("ref_chars", "text_chars", "ref_words", "blanks", "letters_e", "turn")
_SWEPT = _TURNS + """, v AS (SELECT levenshtein(a, b) / greatest(1, length(a)) AS cer, length(a)::DOUBLE AS ref_chars, length(b)::DOUBLE AS text_chars, (length(a) - length(replace(a, ' ', '')))::DOUBLE AS ref_words, (length(b) - length(replace(b, ' ', '')))::DOUBLE AS blanks, (length(b) - length(regexp_replace(b, '[eE]', '', 'g')))::DOUBLE AS letters_e, turn::DOUBLE AS turn FROM n),
u AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS x, cer AS y FROM v" for m in _TELEMETRY) + """),
k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2.0::DOUBLE AS ry FROM u)
"""


@query(_SWEPT + f"SELECT metric, count(*) AS n, round({_pearson('x', 'y')}, 6) AS r, round({_pearson('rx', 'ry')}, 6) AS rho FROM k GROUP BY 1")
def telemetry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How measures of a turn go with its error rate, all from one unpivoted table."""
    return telemetry_significance(spark, sf_dir).select("metric", "n", "r", "rho")


@query()
def telemetry_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the chance of each correlation under none."""
    pairs = turn_pairs(spark, sf_dir, folded=True)
    a, b = tx.normalised(F.coalesce("ref", F.lit(""))), tx.normalised(F.col("text"))
    without = lambda c, p: (F.char_length(c) - F.char_length(F.regexp_replace(c, p, ""))).cast("double")
    rows = pairs.select(tx.char_error_rate(F.col("ref"), F.col("text")).alias("cer"), F.char_length(a).alias("ref_chars"), F.char_length(b).alias("text_chars"), without(a, " ").alias("ref_words"), without(b, " ").alias("blanks"), without(b, "[eE]").alias("letters_e"), F.col("turn").cast("double").alias("turn"))
    # Read by every ranking below, and an edit distance is dear: written once in the shared folder.
    return rounded(significance.sweep(_written(spark, rows), list(_TELEMETRY), "cer"), "r", "rho", "r_p", "rho_p")


@query(_TURNS + "SELECT conv_id, turn, round(levenshtein(a, b) / greatest(1, length(a)), 6) AS cer, round(greatest(0::DOUBLE, 1 - levenshtein(a, b) / greatest(1, length(a))), 6) AS accuracy, (levenshtein(a, b) / greatest(1, length(a)) >= 0.85 OR b = '') AS failed FROM n")
def ocr_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cer(turn_pairs(spark, sf_dir, folded=True))


@query()
def ocr_cer_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cer(turn_pairs(spark, sf_dir))


def _cer(pairs: DataFrame) -> DataFrame:
    rows = pairs.select("conv_id", "turn", tx.char_error_rate(F.col("ref"), F.col("text")).alias("c"), (tx.normalised(F.col("text")) == "").alias("e"))
    return rows.select("conv_id", "turn", F.round("c", 6).alias("cer"), F.round(F.greatest(F.lit(0.0), 1 - F.col("c")), 6).alias("accuracy"), ((F.col("c") >= 0.85) | F.col("e")).alias("failed"))


@query(_TURNS + "SELECT conv_id, turn, round(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0 ELSE 1 END ELSE least(1::DOUBLE, levenshtein(a, b) / length(a)) END::DOUBLE, 6) AS cer FROM n")
def ocr_capped_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped_cer(turn_pairs(spark, sf_dir, folded=True))


@query()
def ocr_capped_cer_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped_cer(turn_pairs(spark, sf_dir))


def _capped_cer(pairs: DataFrame) -> DataFrame:
    return pairs.select("conv_id", "turn", F.round(tx.capped_char_error_rate(F.col("ref"), F.col("text")), 6).alias("cer"))


@query()
def ocr_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(tx.word_error_rate(F.col("ref"), F.col("text")), 6).alias("wer"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_GOOD = "len({0}) >= {1} AND {0} NOT IN (" + _STOP + ")"
_SP = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]*"


def _profile(hyphen: str, name: str) -> str:
    return f"{name} AS (SELECT item_id AS q, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, list_filter(string_split(regexp_replace(replace(lower(coalesce(text, '')), '-', '{hyphen}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM benchmark))"


# Terms of profiles; words of pages with their places, in both forms; terms on pages; scores; headers; pairs.
_PROFILES = f"""{_profile(' ', 'pw')}, {_profile('', 'pc')},
p AS (SELECT DISTINCT q, ws[i] AS term, false AS phrase FROM pw WHERE {_GOOD.format('ws[i]', 3)} AND NOT regexp_matches(ws[i], '^[0-9]+$') UNION SELECT q, ws[i], false FROM pc WHERE {_GOOD.format('ws[i]', 4)} AND NOT regexp_matches(ws[i], '^[0-9]+$')
 UNION SELECT q, ws[i] || ' ' || ws[i + 1], true FROM pw WHERE i < len(ws) AND {_GOOD.format('ws[i]', 3)} AND {_GOOD.format('ws[i + 1]', 3)}
 UNION SELECT q, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], true FROM pw WHERE i + 1 < len(ws) AND {_GOOD.format('ws[i]', 3)} AND {_GOOD.format('ws[i + 1]', 3)} AND {_GOOD.format('ws[i + 2]', 3)})"""
_MAPPED = f"""WITH {_PROFILES},
tf AS (SELECT doc_id, 0 AS form, replace(lower(text), '-', ' ') AS t FROM documents UNION ALL SELECT doc_id, 1, replace(lower(text), '-', '') FROM documents WHERE text LIKE '%-%'),
tw AS (SELECT doc_id, form, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, form, string_split(regexp_replace(t, '[^a-z0-9_ ]', ' | ', 'g'), ' ') AS ws FROM tf)),
g AS (SELECT DISTINCT doc_id AS page_id, term FROM (SELECT doc_id, ws[i] AS term FROM tw UNION ALL SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM tw WHERE i < len(ws) UNION ALL SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM tw WHERE i + 1 < len(ws))),
z AS (SELECT q, greatest(1, count(*) FILTER (NOT phrase)) AS n FROM p GROUP BY 1),
h AS (SELECT page_id, q AS question_id, count(*) FILTER (NOT phrase) AS hits, count(*) FILTER (phrase) AS phrases FROM g JOIN p USING (term) GROUP BY ALL),
s AS (SELECT page_id, question_id, hits, phrases, least(0.98::DOUBLE, least(0.55::DOUBLE, 0.25::DOUBLE * phrases) + 0.55::DOUBLE * hits / n + CASE WHEN hits >= 4 THEN 0.35::DOUBLE WHEN hits >= 3 THEN 0.25 WHEN hits >= 2 THEN 0.15 ELSE 0 END) AS score FROM h JOIN z ON z.q = question_id),
ok AS (SELECT * FROM s WHERE score >= 0.5 OR (hits >= 3 AND score >= 0.4)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, question_id) AS k FROM ok),
m AS (SELECT page_id, question_id, hits, phrases, round(score, 6) AS score, round(least(0.96::DOUBLE, greatest(0.7::DOUBLE, score + 0.15::DOUBLE)), 6) AS confidence FROM b WHERE k = 1),
hd AS (SELECT DISTINCT page_id, item_id AS question_id FROM (SELECT doc_id AS page_id, unnest(list_concat(regexp_extract_all(lower(text), '(?:question|q|ans|answer){_SP}#?{_SP}([0-9]+)\\b', 1), regexp_extract_all(lower(text), '\\b([0-9]+){_SP}[.)-]{_SP}[a-z]', 1), regexp_extract_all(lower(text), '\\bq\\.?{_SP}([0-9]+)\\b', 1))) AS number FROM documents)
 JOIN benchmark ON CAST(item_id AS VARCHAR) = number),
c AS (SELECT page_id, question_id, hits, phrases, round(score, 6) AS score, CASE WHEN hd.page_id IS NOT NULL THEN 'AUTO_EXPLICIT' ELSE 'AUTO_SEMANTIC' END AS source,
 round(CASE WHEN hd.page_id IS NOT NULL THEN 0.85::DOUBLE ELSE least(0.96::DOUBLE, greatest(0.7::DOUBLE, score + 0.15::DOUBLE)) END, 6) AS confidence FROM hd FULL JOIN ok USING (page_id, question_id))
"""


@query(f"WITH {_PROFILES} SELECT q AS question_id, term, phrase FROM p")
def question_profile_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.profile_terms(_profiles(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


@query(_MAPPED + "SELECT * FROM m")
def automap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tx.map_pages(_pages(spark, sf_dir), _profiles(spark, sf_dir)), "score", "confidence")


@query(_MAPPED + "SELECT * FROM c")
def automap_page_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tx.map_page_questions(_pages(spark, sf_dir), _profiles(spark, sf_dir)), "score", "confidence")


@query(_MAPPED + """, f AS (SELECT page_id + 1 AS page_id, question_id, confidence FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.page_id = c.page_id + 1 AND d.question_id = c.question_id)),
t AS (SELECT doc_id, regexp_matches(lower(text), 'continued|contd|example:|for example|algorithm:|steps:|advantages:|disadvantages:|diagram:|hence proven|code:') AS cue FROM documents WHERE length(trim(text)) >= 20)
SELECT page_id, question_id, hits, phrases, 'AUTO_CONTINUATION' AS source, confidence FROM f JOIN s USING (page_id, question_id) JOIN t ON t.doc_id = page_id
WHERE (hits >= 2 OR phrases >= 1 OR score >= 0.35 OR (cue AND hits >= 1)) AND NOT EXISTS (SELECT 1 FROM hd WHERE hd.page_id = f.page_id AND hd.question_id <> f.question_id)""")  # fmt: skip
def continuation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, profiles = _pages(spark, sf_dir), _profiles(spark, sf_dir)
    # Both are read several times below, and every reading would split all pages again: written once in the shared folder.
    headers, scores = _written(spark, tx.page_headers(pages, profiles)), _written(spark, tx.page_scores(pages, profiles))
    return rounded(tx.continuations(pages, tx.combined(headers, scores), headers, scores), "confidence")


@query(_MAPPED + "SELECT question_id, count(*) AS n_pages, arg_max(source, page_id) AS source, max(confidence) AS confidence, max(confidence) >= 0.85 AS confident, min(page_id) AS first_page FROM c GROUP BY 1")
def mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's mapping: its pages, the highest confidence, and the way of the last page that matched."""
    best = F.max("confidence")
    return automap_page_questions(spark, sf_dir).groupBy("question_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max_by("source", "page_id").alias("source"), best.alias("confidence"), (best >= 0.85).alias("confident"), F.min("page_id").alias("first_page"))


@query(_MAPPED + """, u AS (SELECT question_id, count(*) AS n_pages, max(confidence) AS confidence FROM c GROUP BY 1)
SELECT item_id AS question_id, coalesce(n_pages, 0) AS n_pages, CASE WHEN item_id % 7 = 0 THEN 'EXAMINER_VERIFIED' WHEN n_pages IS NULL THEN 'UNRESOLVED' ELSE 'AUTO' END AS source, CASE WHEN item_id % 7 = 0 THEN false ELSE coalesce(confidence < 0.85::DOUBLE, true) END AS needs_review, item_id % 7 = 0 AND n_pages > 0 AS kept_as_suggestion FROM benchmark LEFT JOIN u ON question_id = item_id""".replace("item_id % 7 = 0 AND n_pages > 0", "(item_id % 7 = 0 AND coalesce(n_pages, 0) > 0)"))  # fmt: skip
def mapping_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final mapping: what an examiner verified (each seventh question here) stays, with found pages kept as a suggestion; questions without pages are unresolved; what is not confident needs review."""
    found = automap_page_questions(spark, sf_dir).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"))
    rows = _profiles(spark, sf_dir).select("question_id").join(found, "question_id", "left")
    verified, n = F.col("question_id") % 7 == 0, F.coalesce("n", F.lit(0)).cast("bigint")
    source = F.when(verified, "EXAMINER_VERIFIED").when(F.col("n").isNull(), "UNRESOLVED").otherwise("AUTO")
    return rows.select("question_id", n.alias("n_pages"), source.alias("source"), F.when(verified, False).otherwise(F.coalesce(F.col("c") < 0.85, F.lit(True))).alias("needs_review"), (verified & (n > 0)).alias("kept_as_suggestion"))


_HEAD = r"regexp_extract(text, '(?im)(?:^|[^A-Za-z0-9_])(?:q(?:uestion)?|ans(?:wer)?)[.\s]*([0-9]{1,3})(?:[^A-Za-z0-9_]|$)', 1)"


@query(D + rf""", t AS (SELECT part.p_partkey AS question_id, 'Q' || p_size || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE 'a' END || p_name AS text FROM part)
SELECT question_id, nullif({_HEAD}, '')::INT AS header FROM t""")  # fmt: skip
def explicit_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = domain.table(spark, sf_dir, "part")
    text = F.concat(F.lit("Q"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " ").otherwise("a"), F.col("p_name"))
    return part.select(F.col("p_partkey").alias("question_id"), tx.explicit_header(text).alias("header"))


def _redacted_sql(text: str) -> str:
    for pattern, to in tx.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


# Each text and, where its id is even, the secrets that an error message may carry.
_MESSAGE = "text || CASE WHEN doc_id % 2 = 0 THEN ' GET /v1?key=abc' || doc_id || '&x=1 Authorization: bearer tok.' || doc_id || ' AIzaSy_' || doc_id || '-x AQ.Ab8' || doc_id ELSE '' END"


@query(f"SELECT doc_id, md5({_redacted_sql('t')}) AS redacted, ({_redacted_sql('t')} <> t) AS changed FROM (SELECT doc_id, {_MESSAGE} AS t FROM documents)")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.table(spark, sf_dir, "documents").select("doc_id", F.expr(_MESSAGE).alias("t"))
    clean = tx.redacted(F.col("t"))
    return rows.select("doc_id", F.md5(clean.cast("binary")).alias("redacted"), (clean != F.col("t")).alias("changed"))


@query("""WITH a AS (SELECT source, string_agg('--- Page ' || n || ' ---' || chr(10) || text, chr(10) ORDER BY n) AS t, count(*) AS n_pages FROM (SELECT source, text, row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) AS n, doc_id // 100 AS book FROM documents) GROUP BY source, book)
SELECT source, n_pages, length(t) AS n_chars, md5(t) AS digest FROM a""")  # fmt: skip
def ordered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.floor(F.col("doc_id") / 100)
    grouped = domain.table(spark, sf_dir, "documents").groupBy("source", book.alias("book")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), x.text)), "\n")
    return grouped.select("source", F.size("p").cast("bigint").alias("n_pages"), text.alias("t")).select("source", "n_pages", F.char_length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))
