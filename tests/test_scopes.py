"""Scopes, guarded writes and rules on hand-made rows, and box clusters against a plain loop."""

import math
import re

import pytest
from pyspark.sql import functions as F

from examlake.operators import rules, scopes
from examlake.plans import gates, ingest
from examlake.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("percent", "want"),
    [
        (90.0, ("A+", 10, "FIRST_CLASS_DISTINCTION")), (89.995, ("A+", 10, "FIRST_CLASS_DISTINCTION")), (80.0, ("A", 9, "FIRST_CLASS_DISTINCTION")), (79.99, ("B+", 8, "FIRST_CLASS")), (75.0, ("B+", 8, "FIRST_CLASS")),
        (69.99, ("B", 7, "HIGHER_SECOND_CLASS")), (50.0, ("C", 6, "SECOND_CLASS")), (40.0, ("P", 4, "PASS")), (39.99, ("F", 0, "FAIL")), (None, (None, None, None)),
    ],
)
def test_grades(spark, percent, want):
    row = spark.createDataFrame([(percent,)], "p double").select(*[c.alias(n) for c, n in zip(rules.grade(F.col("p")), "gpc", strict=True)]).first()
    assert tuple(row) == want


def test_book_steps_that_are_not_legal(spark):
    steps = spark.createDataFrame([("ASSIGNED", "READY"), ("IN_PROGRESS", "ASSIGNED"), ("READY", "ASSIGNED"), ("RETURNED", "IN_PROGRESS"), ("FINALIZED", "FINALIZED"), (None, "SUBMITTED")], "before string, after string")
    assert sorted(map(tuple, rules.illegal_steps(steps, rules.BOOK_NEXT).collect())) == [("ASSIGNED", "READY"), ("IN_PROGRESS", "ASSIGNED")]


def test_filters_and_scopes(spark):
    rows = spark.createDataFrame([(1, "A", 7), (2, "B", 7), (3, None, 8)], "id long, status string, owner long")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(scopes.filtered(rows, status="ALL", owner=None)) == [1, 2, 3]
    assert ids(scopes.filtered(rows, status="A")) == [1] and ids(scopes.filtered(rows, status="B", owner=8)) == []
    assert ids(scopes.in_scope(rows, "EXAMINER", F.col("owner") == 7)) == [1, 2] and ids(scopes.in_scope(rows, "ADMIN", F.col("owner") == 7)) == [1, 2, 3]
    after = scopes.updated(rows, F.col("status") == "A", owner=F.lit(9).cast("long")).collect()
    assert sorted((r.id, r.owner, r._changed) for r in after) == [(1, 9, True), (2, 7, False), (3, 8, False)]
    free, used = scopes.deletable(rows, spark.createDataFrame([(2,), (2,)], "id long"), "id")
    assert ids(free) == [1, 3] and ids(used) == [2]


def test_identities(spark):
    rows = spark.createDataFrame([(" Ab ", "aB"), ("", ""), (None, None), ("x", None)], "a string, b string")
    assert [r.s for r in rows.select(scopes.same_identity(F.col("a"), F.col("b")).alias("s")).collect()] == [True, False, False, False]


def test_clusters_of_boxes_equal_a_plain_loop(spark):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(0, w) * max(0, h)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both + 1e-6)

    def apart(a, b):
        corners = lambda c: [(c[0], c[1]), (c[2], c[1]), (c[2], c[3]), (c[0], c[3])]
        return sum(math.dist(p, q) for p, q in zip(corners(a), corners(b), strict=True)) / 4

    kept, want = {}, {}
    for r in sorted(ingest.boxes(spark, SF).collect(), key=lambda r: (r.page_id, r.box, r.x0, r.y0, r.x1, r.y1)):
        box = tuple(map(float, (r.x0, r.y0, r.x1, r.y1)))
        first = next((k for k, b in kept.setdefault(r.page_id, []) if iou(b, box) >= 0.94 and apart(b, box) <= 25), None)
        if first is None:
            kept[r.page_id].append((r.box, box))
        want.setdefault((r.page_id, first if first is not None else r.box), []).append(r.box)
    got = {(r.page_id, r.cluster): (r.n_boxes, r.mean_box) for r in gates.hypothesis_clusters(spark, SF).collect()}
    assert got == {k: (len(v), float(math.floor(sum(v) / len(v) + 0.5))) for k, v in want.items()}
    assert any(n > 1 for n, _ in got.values())


def test_a_stream_names_its_estimate(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    assert "users" in events.windowed(rows.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").columns
    rows.limit(5).write.parquet(str(tmp_path / "in"))
    assert events.windowed(events.event_stream(spark, str(tmp_path / "in")), "1 day").columns[-1] == "about_users"


def test_issues_of_the_ledger_are_made_after_all_joins(spark):
    from examlake.plans import ledger

    lines = ledger.integrity_ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(re.match(r"[ :+-]*", line).group()) for line in lines]
    below = lambda i: lines[i + 1 : next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))]
    joins = [i for i, line in enumerate(lines) if line[depth[i] :].startswith("Join")]
    assert joins and any("Generate" in line for line in lines)
    assert not any("Generate" in line for i in joins for line in below(i))
