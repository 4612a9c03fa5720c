import math
import random

import numpy as np
from pyspark.sql import functions as F

from examlake.operators import correction, geometry
from examlake.sources import ingest


def test_media_checks_and_names(spark):
    rows = spark.createDataFrame([("image/png", bytes.fromhex("89504E47") + b"x" * 20), ("image/png", b"y" * 30), ("image/gif", b"z" * 30), ("image/jpeg", b"\xff\xd8\xff"), (None, None)], "mime string, content binary")
    got = [r.p for r in rows.select(ingest.media_problem(F.col("mime"), F.col("content")).alias("p")).collect()]
    assert got == [None, "BAD_SIGNATURE", "UNSUPPORTED_TYPE", "EMPTY", "UNSUPPORTED_TYPE"]
    names = spark.createDataFrame([("page_3", 0), ("file-07", 1), ("12", 2), ("scan", 3)], "f string, i int")
    assert [r.n for r in names.select(ingest.page_number(F.col("f"), F.col("i")).alias("n")).collect()] == [3, 7, 12, 4]
    assert spark.range(1).select(ingest.object_key(F.lit("MATH"), F.lit(5), F.lit(3)).alias("k")).first().k == "exams/MATH/answer-books/5/pages/page-0003"


def test_sources_in_order(spark):
    rows = spark.createDataFrame([("", None, "u"), ("m", "d", "u"), (None, None, None)], "memory string, disk string, url string")
    name, value = ingest.first_source(memory=F.col("memory"), disk=F.col("disk"), url=F.col("url"))
    assert [tuple(r) for r in rows.select(name.alias("n"), value.alias("v")).collect()] == [("url", "u"), ("memory", "m"), (None, None)]


def test_model_reply_gets_defaults(spark):
    reply = '```json\n[{"text": "a", "marks": 0}, {"number": 7, "marks": 0.1}, {"number": 9, "text": "c", "marks": 4}]\n```'
    got = spark.createDataFrame([(reply,), ("no json",), (None,)], "r string").select(ingest.extracted_questions(F.col("r")).alias("q")).collect()
    assert [tuple(q) for q in got[0].q] == [(1, "a", 10.0), (7, "", 0.5), (9, "c", 4.0)]
    assert got[2].q == []


def test_merge_and_insert(spark):
    current = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, x double")
    changes = spark.createDataFrame([(1, "late", None, 5), (1, None, 9.0, 9), (1, "early", 4.0, 1), (3, None, 2.0, 1)], "k int, s string, x double, at int")
    assert sorted(map(tuple, ingest.merged(current, changes, ["k"], "at").collect())) == [(1, "late", 9.0), (2, "b", None), (3, None, 2.0)]
    new, refused = ingest.insert_new(current, spark.createDataFrame([(2, "z"), (4, "n"), (4, "m")], "k int, s string"), ["k"])
    assert sorted(map(tuple, new.collect())) == [(4, "m")] and sorted(map(tuple, refused.collect())) == [(2, "z"), (4, "n")]
    marks = spark.sql("select array(named_struct('question_number', 1, 'status', 'A'), named_struct('question_number', 2, 'status', 'B')) as m").select(ingest.with_mark(F.col("m"), F.lit(2), "status", F.lit("C")).alias("m"))
    assert [tuple(x) for x in marks.first().m] == [(1, "A"), (2, "C")]


def test_exports_and_images(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "b")], "k int, s string")
    ingest.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "csv")).collect()) == ['"1","—"', '"2","b"', '"k","s"']
    ingest.write_json(rows, str(tmp_path / "json"))
    assert '{"k":1,"s":null}' in [x.value for x in spark.read.text(str(tmp_path / "json")).collect()]
    for _ in range(2):
        ingest.append_audit(rows, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"\xff\xd8\xff" + b"0" * 20)
    (tmp_path / "img" / "b.txt").write_bytes(b"no")
    assert [r.length for r in ingest.page_images(spark, str(tmp_path / "img")).collect()] == [23]


def test_greedy_boxes(spark):
    rng = random.Random(3)
    rows = [(p, b, float(x := rng.randint(0, 12)), 0.0, float(x + 100), 50.0) for p in range(40) for b in range(rng.randint(1, 9))]
    want, kept = {}, {}
    for p, b, *xy in rows:
        hit = next((k for k, other in kept.setdefault(p, []) if geometry._iou(other, xy) >= 0.9), None)
        if hit is None:
            kept[p].append((b, xy))
        want[p, b] = b if hit is None else hit
    got = geometry.greedy_boxes(spark.createDataFrame(rows, "page_id long, box long, x0 double, y0 double, x1 double, y1 double").repartition(5))
    assert {(r.page_id, r.box): r.kept_by for r in got.collect()} == want


def test_stable_frames(spark):
    moves = [0.01, 0.02, 0.5, 0.01, 0.01, 0.01, 0.01, None, 0.01]
    rows = spark.createDataFrame([(1, i, m) for i, m in enumerate(moves)], "cam long, i long, m double")
    got = {r.i: (r.stable_frames, r.ready) for r in geometry.hysteresis(rows, "cam", "i", "m").collect()}
    assert [got[i][0] for i in range(9)] == [1, 2, 1, 2, 3, 3, 3, 0, 1] and got[7] == (0, False)


def test_quadrilaterals(spark):
    point = "array(named_struct('x', {}D, 'y', {}D), named_struct('x', {}D, 'y', {}D), named_struct('x', {}D, 'y', {}D), named_struct('x', {}D, 'y', {}D))"
    shapes = {
        "a": (20, 20, 120, 20, 120, 120, 20, 120), "b": (20, 20, 120, 20, 185, 90, 85, 90), "c": (-9, 20, 120, 20, 120, 120, 20, 120), "d": (20, 20, 60, 20, 60, 60, 20, 60), "e": (0, 0, 199, 0, 199, 199, 0, 199),
        "f": (5, 5, 150, 5, 150, 150, 5, 150), "g": (20, 20, 186, 20, 186, 55, 20, 55), "h": (5, 60, 195, 60, 195, 100, 20, 100), "i": (-8, 20, 120, 20, 120, 120, 20, 120),
    }
    rows = spark.sql("select " + ", ".join(f"{point.format(*v)} as {k}" for k, v in shapes.items()))
    w = F.lit(200.0)
    got = rows.select(*[geometry.quadrilateral_problem(F.col(c), w, w).alias(f"p{c}") for c in shapes], geometry.corner_distances(F.col("a"), F.col("c")).alias("d"), geometry.ordered_corners(F.col("a")).alias("o")).first()
    assert [got[f"p{c}"] for c in shapes] == [None, "BAD_ANGLE", "OUT_OF_FRAME", "TOO_SMALL", "TOO_LARGE", "FRAME_BORDER", "BAD_ASPECT", "FRAME_BORDER", None]
    assert got.d.max_distance == 29.0
    angles = [math.atan2(p.y - 70, p.x - 70) for p in got.o]
    assert angles == sorted(angles)


def test_corrections_are_verified():
    shadow = np.tile(np.linspace(60, 200, 8), (8, 1))
    shadow[::2] -= 40
    after, log = correction.correct(shadow)
    assert log[0] == "SHADOW:COMMITTED" and correction.deficit(after) < correction.deficit(shadow)
    flat = np.full((8, 8), 120.0)
    assert correction.correct(flat)[1] == ["CONTRAST:ROLLED_BACK"] and (correction.correct(flat)[0] == flat).all()
    clear = np.where(np.indices((8, 8)).sum(axis=0) % 2, 250.0, 0.0)
    assert correction.correct(clear)[1] == []
