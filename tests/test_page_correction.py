"""Corrections of whole pages: what is kept, what is taken back, and each gate."""

import hashlib

import numpy as np
import pytest

from examlake.operators import page_correction as fix
from examlake.operators import page_images
from examlake.plans import regions as plans


def written(h=420, w=340, paper=225, ink=50, to=1.0):
    g, rng = np.full((h, w), paper, np.uint8), np.random.default_rng(2)
    for y in range(34, int(h * to) - 40, 19):
        for x in 34 + np.cumsum(rng.integers(11, 17, 40)):
            if x > w - 46:
                break
            g[y : y + 11, x : x + 2] = g[y + 4 : y + 6, x : x + 8] = g[y : y + 11, x + 6 : x + 8] = ink
    return g


def shaded(h=420, w=340):
    """A page with a shadow over its foot, where hardly anything is written."""
    light = np.clip(1.0 - 0.4 * np.clip((np.arange(h) / h - 0.72) / 0.06, 0, 1), 0.6, 1.0)
    return (written(h, w, 240, ink=90, to=0.8) * light[:, None]).astype(np.uint8)


def test_clean_pages_call_for_nothing():
    page, end, tried = fix.corrected(written())
    assert end == "CLEAN" and tried == [] and (page == written()).all()


def test_the_first_fatal_defect_settles_it(monkeypatch):
    asked = []
    for name, f in page_images.MEASURES.items():
        monkeypatch.setitem(page_images.MEASURES, name, lambda p, name=name, f=f: asked.append(name) or f(p))
    cut = written()
    cut[400:420, 40:60] = cut[400:420, 80:100] = cut[400:420, 120:140] = 50
    assert fix.is_fatal(fix.Look(cut)) and asked == ["clipped_px"]
    assert not fix.is_fatal(fix.Look(written())) and asked[1:] == list(fix.FATAL)


def test_shadow_is_corrected_and_proved():
    before = shaded()
    page, end, tried = fix.corrected(before)
    assert end == "CORRECTED" and tried[0].step == "SHADOW_NORMALIZATION" and tried[0].verdict == "PASS" and (tried[0].parent, tried[0].version) == (0, 1)
    assert page_images.evidence(page)["background_ratio"] > 0.85 > 0.68 > page_images.evidence(before)["background_ratio"]
    assert before.flags.writeable and (before == shaded()).all()  # the first version is as it was


def test_weak_contrast_is_drawn_apart():
    page, end, tried = fix.corrected(written(paper=170, ink=125))
    assert end == "CORRECTED" and [t.step for t in tried] == ["CONTRAST_NORMALIZATION"] and tried[0].measures["contrast_gain"] >= 15
    assert page.max() == 255 and page.min() == 0


def test_fatal_pages_are_not_touched():
    faint = written(paper=200, ink=186)
    assert fix.is_fatal(page_images.Page(faint)) and fix.corrected(faint)[1:] == ("FATAL", [])


def test_bad_steps_are_taken_back_and_spent():
    page = shaded()
    ruin = {
        "A": fix.Step("A", "X", 1, lambda p: True, lambda p: np.full_like(p.grey, 200)),
        "B": fix.Step("B", "X", 2, lambda p: True, lambda p: p.grey.copy()),
        "C": fix.Step("C", "X", 3, lambda p: True, lambda p: np.clip(p.grey.astype(int) + np.random.default_rng(0).integers(-60, 60, p.grey.shape), 0, 255).astype(np.uint8)),
    }
    kept, end, tried = fix.corrected(page, ruin)
    assert end == "KEPT" and (kept == page).all() and [t.step for t in tried] == ["A", "B", "C"] and all(t.version == 0 for t in tried)
    assert "STROKES_LOST" in tried[0].reasons and tried[1].reasons == ["NO_CHANGE"] and "NOISE" in tried[2].reasons
    both = fix.corrected(page, ruin | fix.REGISTRY)
    assert both[1] == "CORRECTED" and [t.verdict for t in both[2]][:3] == ["FAIL"] * 3 and both[2][3].version == 1


def test_gates_one_by_one():
    page = fix.Look(written())
    good = dict.fromkeys(fix.MEASURES, 0.0) | {"survival": 1.0, "regions": 1.0, "contrast_gain": 20.0}
    for step, change, reason in (
        ("X", {"survival": 0.79}, "STROKES_LOST"), ("X", {"faint_loss": 0.16}, "FAINT_STROKES_LOST"), ("X", {"halo": 17.0}, "HALO"), ("X", {"regions": 1.21}, "FRAGMENTED"), ("X", {"regions": 0.79}, "FRAGMENTED"),
        ("X", {"noise": 3.1}, "NOISE"), ("CONTRAST_NORMALIZATION", {"contrast_gain": 14.9}, "CONTRAST_REMAINS"), ("SHADOW_NORMALIZATION", {}, "SHADOW_REMAINS"), ("CONTRAST_NORMALIZATION", {"regions": 1.24, "noise": 8.5}, None), ("X", {}, None),
    ):
        pair = fix.Pair(step, page, page)
        assert [n for n, fails in fix.GATES if fails(pair, good | change)] == ([reason] if reason else [])


def test_a_page_without_strokes_proves_nothing():
    blank = fix.Look(np.full((60, 60), 180, np.uint8))
    assert fix.proved("X", blank, np.full((60, 60), 240, np.uint8))[:2] == ("INSUFFICIENT_EVIDENCE", ["FEW_STROKES"])


def test_faint_strokes_are_counted_plainly():
    grey = written(paper=220, ink=60)
    grey[105:107, 60:280] = 190  # a faint rule
    before, after = fix.Look(grey), fix.Look(np.where(grey == 190, 220, grey).astype(np.uint8))
    loss = fix.Pair("X", before, after).faint_loss()
    faint = [(y, x) for y, x in np.argwhere(before.strokes_near) if 10 <= int(before.depth[y, x]) <= 35]
    assert loss == pytest.approx(1 - sum(bool(after.strokes_near[p]) for p in faint) / len(faint)) and loss > 0.15


def test_rows(spark):
    pages = {"shade": shaded(), "clean": written()}
    rows = [(k, p.shape[1], p.shape[0], bytearray(p.tobytes())) for k, p in pages.items()] + [("none", 10, 10, None), (None, 10, 10, bytearray(5))]
    got = {r.page_id: r for r in fix.corrected_pages(spark.createDataFrame(rows, "page_id string, width int, height int, pixels binary")).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"shade": "CORRECTED", "clean": "CLEAN", "none": "UNREADABLE", None: "UNREADABLE"}
    assert bytes(got["shade"].pixels) == fix.corrected(shaded())[0].tobytes() and got["shade"].tried[0].survival == pytest.approx(fix.corrected(shaded())[2][0].measures["survival"], abs=1e-6)
    assert fix.corrected_pages(spark.createDataFrame([], "page_id string, width int, height int, pixels binary")).count() == 0


def test_pages_are_drawn_corrected_and_digested_in_one_pass(spark, tmp_path):
    """No pixels are moved to Spark and back: one pass of Python, whose digests are those of the pages that ``corrected_pages`` gives."""
    spark.createDataFrame([(1, "abc de" * 200), (2, None), (3, "x" * 700)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = plans.page_image_corrections(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = {r.page_id: r for r in fix.corrected_pages(plans.page_rasters(spark, str(tmp_path))).collect()}
    rows = found.collect()
    assert {r.page_id for r in rows} == set(apart) == {"1:1", "1:2", "2:1", "3:1"}
    assert all((r.outcome, r.page_digest) == (apart[r.page_id].outcome, hashlib.md5(apart[r.page_id].pixels).hexdigest()) for r in rows)


def test_stroke_contrast_equals_plain_middle_and_share():
    rng = np.random.default_rng(9)
    for levels in ((0, 256), (150, 200)):
        look = fix.Look(rng.integers(*levels, (120, 140)).astype(np.uint8))
        depth = look.depth[look.strokes_near]
        assert look.stroke_contrast() == (np.median(depth), ((depth >= 10) & (depth <= 35)).mean())
    assert fix.Look(np.full((60, 60), 200, np.uint8)).stroke_contrast() == (100.0, 0.0)
