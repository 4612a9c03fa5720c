"""p-values against tabulated ones, timers over restarts, scorers from outside."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from examlake.operators import scorers, significance, statistics
from examlake.streaming import timers


def t_tail(t, df):
    """Two-sided chance by Simpson's rule over the density, for moderate df."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    u = np.linspace(0, math.atan(t / math.sqrt(df)), 20001)  # x = sqrt(df) tan u
    f = c * math.sqrt(df) * np.cos(u) ** (df - 1)
    return 1 - 2 * (u[1] - u[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())


def test_p_values_of_known_quantiles(spark):
    # Quantiles of Student's t that leave 5 and 1 per cent outside.
    known = [(1, 12.706204736432095, 0.05), (2, 4.302652729911275, 0.05), (5, 2.570581835636314, 0.05), (10, 2.2281388519649385, 0.05), (30, 2.0422724563012373, 0.05), (120, 1.9799304050824413, 0.05), (5, 4.032142983557536, 0.01), (30, 2.7499956535672283, 0.01)]
    rows = [(t / math.sqrt(df + t * t) * (-1) ** df, df + 2, p) for df, t, p in known]
    for r, n, p, got in spark.createDataFrame(rows, "r double, n long, p double").select("r", "n", "p", significance.t_two_sided(F.col("r"), F.col("n"))).collect():
        assert got == pytest.approx(p, abs=1e-9), (r, n)


def test_p_values_equal_the_integrated_density(spark):
    rows = [(r, n) for r in (0.001, 0.03, 0.2, 0.5, 0.9, 0.999) for n in (3, 4, 7, 20, 200, 3000)]
    for r, n, got in spark.createDataFrame(rows, "r double, n long").select("r", "n", significance.t_two_sided(F.col("r"), F.col("n"))).collect():
        assert got == pytest.approx(t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2), abs=2e-9), (r, n)
    edge = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.0, 9), (0.5, 2), (None, 9), (0.001, 4_000_000)], "r double, n long").select(significance.t_two_sided(F.col("r"), F.col("n")).alias("p"))
    p = [r.p for r in edge.collect()]
    assert p[:5] == [0.0, 0.0, 1.0, None, None] and p[5] == pytest.approx(math.erfc(0.001 * math.sqrt(4e6) / math.sqrt(2)), abs=1e-5)


def test_sweep_equals_plain_ranks(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(size=300)
    data = pd.DataFrame({"a": np.round(y + rng.normal(size=300), 1), "b": rng.integers(0, 4, 300), "c": 5.0, "y": np.round(y, 1)})
    data.loc[:20, "a"] = None
    got = {r.metric: r for r in significance.sweep(spark.createDataFrame(data).replace(float("nan"), None), ["a", "b", "c"], "y").collect()}
    for m in "ab":
        d = data.dropna(subset=[m])
        assert got[m].n == len(d) and got[m].r == pytest.approx(np.corrcoef(d[m], d["y"])[0, 1]) and got[m].rho == pytest.approx(np.corrcoef(d[m].rank(), d["y"].rank())[0, 1])
    assert (got["c"].r, got["c"].r_p, got["c"].rho_p) == (0, 1, 1) and got["a"].r_p < 1e-6


def test_a_job_without_events_expires_also_over_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job string, final boolean"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    rows = lambda: {(r.job, r.outcome, r.heard) for r in spark.read.schema("job string, outcome string, heard long").parquet(f"{out}/rows").collect()} if (tmp_path / "out" / "rows").exists() else set()

    def start():
        stream = timers.watched_jobs(spark.readStream.schema(schema).parquet(source), 4000)
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        return stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(processingTime="500 milliseconds").start()

    add(("quick", False), ("quick", True), ("slow", False), ("slow", None))
    query = start()
    assert timers.wait_until(lambda: ("quick", "ENDED", 2) in rows(), 60)
    query.stop()
    assert not any(r[0] == "slow" for r in rows())
    time.sleep(4)  # the timer runs out while nothing runs
    add(("other", False))  # the first trigger after a restart needs an event of any job
    query = start()
    try:
        assert timers.wait_until(lambda: ("slow", "EXPIRED", 2) in rows(), 60), (query.exception(), rows())
        add(("slow", True))
        assert timers.wait_until(lambda: ("slow", "ENDED", 1) in rows(), 60), (query.exception(), rows())
    finally:
        query.stop()


def test_stale_views_are_told_once(spark):
    rows = [("evaluation.started", "e1", 3), ("evaluation.submitted", "e1", 1), ("script.finalized", None, 5), ("other", "e1", 9), (None, "e1", 9)]
    got = {(r["view"], r["scope"], r["events"], r["since"]) for r in timers.stale_views(spark.createDataFrame(rows, "event string, scope string, ts long")).collect()}
    assert got == {("monitoring-books", "e1", 2, 1), ("monitoring-evaluations", "e1", 2, 1), ("monitoring-books", None, 1, 5)}


def test_scorers_late_failing_and_in_time(spark):
    rows = spark.createDataFrame([(k, 1, f"page {k}", "q") for k in range(6)] + [(None, None, None, None)], "page_id long, question int, page_text string, question_text string").coalesce(1)

    def steady(d):
        return pd.DataFrame({"confidence": [2.0 if p == 0 else None if p == 1 else 0.7 for p in d["page_id"].fillna(1)], "evidence": ["seen"] * len(d)})

    def slow(d):
        if (d["page_id"] == 2).any():
            time.sleep(5)
        return steady(d)

    def broken(d):
        raise RuntimeError("no model")

    got = {r.page_id: r for r in scorers.scored(rows, scorers.register("steady", steady, 20)).collect()}
    assert (got[0].confidence, got[0].outcome, got[0].evidence) == (1.0, "SCORED", "seen") and (got[1].outcome, got[None].outcome) == ("FAILED", "FAILED") and got[3].confidence == 0.7
    late = {r.page_id: r.outcome for r in scorers.scored(rows, scorers.Scorer("slow", slow, 1.0, 2)).collect()}
    assert late == {0: "SCORED", 1: "FAILED", 2: "LATE", 3: "LATE", 4: "SCORED", 5: "SCORED", None: "FAILED"}
    assert {r.outcome for r in scorers.scored(rows, scorers.Scorer("broken", broken, 5.0, 64)).collect()} == {"FAILED"}


def test_only_unresolved_questions_are_asked(spark):
    asked = "book string, page_id long, page_text string"
    pages = spark.createDataFrame([("x", 1, "ab"), ("x", 2, ""), ("x", 3, None), ("y", 4, "cd")], asked)
    questions = spark.createDataFrame([("x", 1, "a"), ("x", 2, None), ("y", 1, "c"), ("z", 1, "c")], "book string, question int, question_text string")
    mapped = spark.createDataFrame([("x", 1, 1, 0.9, "AUTO")], "book string, page_id long, question int, confidence double, source string")
    share = scorers.Scorer("share", lambda d: pd.DataFrame({"confidence": [0.65 if q in p else 0.64 for p, q in zip(d["page_text"], d["question_text"], strict=True)], "evidence": [""] * len(d)}), 20.0, 8)
    got = {tuple(r) for r in scorers.with_fallback(mapped, pages, questions, share).collect()}
    assert got == {("x", 1, 1, 0.9, "AUTO"), ("x", 1, 2, 0.65, "AUTO_MULTIMODAL"), ("y", 4, 1, 0.65, "AUTO_MULTIMODAL")}
    assert scorers.with_fallback(mapped, pages, questions, None).count() == 1
    assert scorers.with_fallback(mapped.where("false"), pages.where("false"), questions, share).count() == 0


def test_a_value_that_most_rows_have_is_ranked_as_one_row(spark):
    rows = spark.createDataFrame([("a", 5.0)] * 500 + [("a", 1.0), ("a", None), ("a", 9.0), ("b", 5.0), (None, 2.0), (None, 2.0)], "g string, x double")
    ranks = statistics.value_ranks(rows, ["g"], "x", "r")
    assert {(r.g, r.x): r.r for r in ranks.collect()} == {("a", None): 1.0, ("a", 1.0): 2.0, ("a", 5.0): 252.5, ("a", 9.0): 503.0, ("b", 5.0): 1.0, (None, 2.0): 1.5}
    assert ranks.count() == 6 and statistics.average_ranks(rows, ["g"], "x", "r").where("r = 252.5").count() == 500


def test_edit_distances_of_turns_are_taken_once(spark):
    from examlake.plans import statistics as plans

    found = plans.telemetry_significance(spark, "/root/testdata/sf0.001")
    assert "levenshtein" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 6
