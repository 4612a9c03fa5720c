"""Page-image measures on grey grids with array functions, and the decisions over image evidence.

A grid is an array of side * side values, row by row. Kernels that arrays express run as columns;
the others are NumPy functions over Arrow batches (``grid_kernels``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp, every_failure, js_round

SIDE = 8


def _inner(grid: Column, at, side: int = SIDE) -> Column:
    """``at(cell)`` for each cell that has four neighbours; ``cell(dy, dx)`` is the value beside it."""
    places = F.array(*[F.lit(y * side + x) for y in range(1, side - 1) for x in range(1, side - 1)])
    return F.transform(places, lambda i: at(lambda dy, dx: F.get(grid, i + dy * side + dx).cast("double")))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def variance(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / F.size(values) - F.pow(mean(values), F.lit(2.0))


def laplacian_variance(grid: Column, side: int = SIDE) -> Column:
    return variance(_inner(grid, lambda c: c(-1, 0) + c(1, 0) + c(0, -1) + c(0, 1) - 4 * c(0, 0), side))


def mean_gradient(grid: Column, side: int = SIDE) -> Column:
    """Mean Sobel magnitude."""
    gx = lambda c: c(-1, 1) + 2 * c(0, 1) + c(1, 1) - c(-1, -1) - 2 * c(0, -1) - c(1, -1)
    gy = lambda c: c(1, -1) + 2 * c(1, 0) + c(1, 1) - c(-1, -1) - 2 * c(-1, 0) - c(-1, 1)
    return mean(_inner(grid, lambda c: F.sqrt(gx(c) * gx(c) + gy(c) * gy(c)), side))


def sharpness_score(v: Column) -> Column:
    """5 to 54.9 below a Laplacian variance of 55, up to 99.5 at 1000; one decimal."""
    return js_round(F.when(v < 55, clamp(50 * v / 55, 5.0, 54.9)).otherwise(55 + 44.5 * F.least(F.lit(1.0), (v - 55) / 945)), 1)


def percentile_of(values: Column, q: float) -> Column:
    """Linear interpolation between the sorted values."""
    s, at = F.array_sort(values), (F.size(values) - 1) * q
    low = F.floor(at).cast("int")
    a, b = F.get(s, low).cast("double"), F.get(s, F.least(low + 1, F.size(values) - 1)).cast("double")
    return a + (b - a) * (at - low)


def contrast_stretch(grid: Column, low: Column, high: Column) -> Column:
    """Grid mapped so that ``low`` is 0 and ``high`` 255 (columns, as of ``percentile_of``); a flat grid stays."""
    span = high - low
    return F.transform(grid, lambda x: F.when(span < 1e-9, x.cast("double")).otherwise(clamp((x - low) * 255.0 / span, 0.0, 255.0)))


def regional_background(grid: Column, side: int = SIDE, cells: int = 4) -> Column:
    """85th percentile of each of cells * cells regions, row by row."""
    k = side // cells
    regions = [F.array(*[F.get(grid, F.lit((cy * k + y) * side + cx * k + x)).cast("double") for y in range(k) for x in range(k)]) for cy in range(cells) for cx in range(cells)]
    return F.array(*[percentile_of(r, 0.85) for r in regions])


def grid_kernels(pages: DataFrame, side: int = SIDE) -> DataFrame:
    """Kernels with no array form: ``page_id``, largest connected ink component, skew (of -10 to 10 degrees) and edge spread.

    Rows are measured one by one in Arrow batches; a null or short grid gives nulls.
    """

    def largest(ink: np.ndarray) -> int:
        label, best = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0), 0
        while True:
            p = np.pad(label, 1)
            new = np.where(ink, np.maximum.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]), 0)
            if (new == label).all():
                break
            label = new
        if label.any():
            best = int(np.bincount(label[label > 0]).max())
        return best

    def skew(g: np.ndarray) -> float:
        y, x = np.mgrid[:side, :side] - (side - 1) / 2
        angles = np.arange(-10, 11)
        spread = [np.var(np.bincount(np.clip(np.round(y * np.cos(a) - x * np.sin(a) + (side - 1) / 2), 0, side - 1).astype(int).ravel(), (g.max() - g).ravel(), side)) for a in np.radians(angles)]
        return float(angles[int(np.argmax(np.round(spread, 9)))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, grid in zip(batch["page_id"], batch["grid"], strict=True):
                if grid is None or len(grid) != side * side:
                    rows.append((page, None, None, None))
                    continue
                g = np.asarray(grid, float).reshape(side, side)
                gy, gx = np.gradient(g)
                m = np.hypot(gx, gy)
                rows.append((page, largest(g < np.percentile(g, 25)), skew(g), float((m > m.max() / 2).mean()) if m.max() > 0 else 0.0))
            yield pd.DataFrame(rows, columns=["page_id", "largest_component", "skew_degrees", "edge_spread"]).astype({"largest_component": "Int64"})

    return pages.select("page_id", "grid").mapInPandas(run, "page_id long, largest_component long, skew_degrees double, edge_spread double")


# Limits beyond which a page is unusable, and within which it is at risk.
FATAL = {"clipped_px": 80, "glare_collision": 0.08, "glare_fraction": 0.04, "acutance": 120, "edge_spread": 4.5, "stroke_contrast": 18, "faint_fraction": 0.60, "margin_occlusion": 0.25, "aspect_deviation": 0.45}
RISK = {"acutance": 220, "stroke_contrast": 35, "faint_fraction": 0.35, "skew": 7, "background_ratio": 0.65, "background_deficit": 45, "otsu_eta": 0.30}


def fatal_defects(e: dict[str, Column]) -> Column:
    """Tier 1: any one makes a page unusable. Evidence that is not given is not judged."""
    off = F.lit(False)
    over = lambda k: e[k] > FATAL[k] if k in e else off
    under = lambda k: e[k] < FATAL[k] if k in e else off
    return every_failure(
        (over("clipped_px"), "FATAL_TEXT_CLIPPED"), (over("glare_collision") | over("glare_fraction"), "FATAL_GLARE_COLLISION"), (under("acutance") | over("edge_spread"), "FATAL_OPTICAL_DEFOCUS"), (under("stroke_contrast") | over("faint_fraction"), "FATAL_INK_LOSS"),
        (over("margin_occlusion") & e.get("geometry_reliable", F.lit(True)), "FATAL_MARGIN_OCCLUSION"), (F.abs(e["aspect_deviation"]) > FATAL["aspect_deviation"] if "aspect_deviation" in e else off, "FATAL_GEOMETRIC_COLLAPSE"),
    )


def risk_factors(e: dict[str, Column], least_height: float = 10.0) -> Column:
    """Tier 2: borderline measures."""
    off = F.lit(False)
    over = lambda k: F.abs(e[k]) > RISK[k] if k in e else off
    under = lambda k: e[k] < RISK[k] if k in e else off
    return every_failure(
        (under("acutance"), "Blur"), (under("stroke_contrast"), "Contrast"), (over("faint_fraction"), "Faint strokes"), (over("skew"), "Skew"), (under("background_ratio") | over("background_deficit"), "Shadow"), (under("otsu_eta"), "Separation"),
        (e["glyph_height"] < least_height if "glyph_height" in e else off, "Small glyphs"), ((e["margin_occlusion"] > FATAL["margin_occlusion"]) & ~e["geometry_reliable"] if "geometry_reliable" in e else off, "Unconfirmed margin"),
    )


def verdict(fatal: Column, risks: Column) -> Column:
    """Tier 3: GOOD, ACCEPTABLE, BORDERLINE or UNUSABLE."""
    soft = ~F.exists(risks, lambda r: r.isin("Blur", "Contrast"))
    return F.when(F.size(fatal) > 0, "UNUSABLE").when(F.size(risks) == 0, "GOOD").when((F.size(risks) == 1) & F.array_contains(risks, "Shadow"), "ACCEPTABLE").when((F.size(risks) <= 2) & soft, "ACCEPTABLE").otherwise("BORDERLINE")


# What an operator is told about each defect.
GUIDANCE = {
    "FATAL_TEXT_CLIPPED": "Position page fully inside camera viewfinder to prevent boundary clipping.",
    "FATAL_OPTICAL_DEFOCUS": "Hold camera steady and ensure optical auto-focus locks on student handwriting.",
    "FATAL_GLARE_COLLISION": "Turn off direct overhead flash or adjust page angle to eliminate specular glare.",
    "FATAL_MARGIN_OCCLUSION": "Remove fingers, clips, or foreign obstructions from the document margins.",
    "FATAL_INK_LOSS": "Handwriting contrast too faint. Ensure well-lit capture or request student use dark pen.",
    "FATAL_GEOMETRIC_COLLAPSE": "Place page flat on a contrasting background to ensure proper corner detection.",
}
# What a reviewer is asked about each risk; %s is the measure beside it.
CHECKLIST = {
    "Blur": ("Inspect character clarity (acutance: %s). Ensure words are decipherable.", "acutance", 1.0, "%.1f"),
    "Contrast": ("Inspect faint stroke segments (faint stroke ratio: %s%%). Check pencil markings.", "faint_fraction", 100.0, "%.1f"),
    "Faint strokes": ("Inspect faint stroke segments (faint stroke ratio: %s%%). Check pencil markings.", "faint_fraction", 100.0, "%.1f"),
    "Shadow": ("Inspect darkest shadow region (quadrant deficit: %s levels). Confirm text not lost.", "background_deficit", 1.0, "%.1f"),
    "Skew": ("Inspect text baseline tilt (%s°). Confirm line grouping is intact.", "skew", 1.0, "%.1f"),
    "Separation": ("Inspect character topological separation (Otsu eta: %s). Confirm characters do not bridge.", "otsu_eta", 1.0, "%.3f"),
}


def guidance(fatal: Column) -> Column:
    """Sentences for the defects found, in their order, with a bar between."""
    says = F.create_map(*[F.lit(x) for kv in GUIDANCE.items() for x in kv])
    return F.array_join(F.transform(fatal, lambda c: F.coalesce(says[c], F.concat(F.lit("Address physical defect: "), c))), " | ")


def checklist(risks: Column, e: dict[str, Column]) -> Column:
    """What to look at on a page for review, an entry for each risk in order; measures that are not given show as null."""
    asked = F.lit(None).cast("string")
    says = {risk: F.format_string(text, F.format_string(form, e[m] * k)) if m in e else asked for risk, (text, m, k, form) in CHECKLIST.items()}

    def entry(risk: Column) -> Column:
        out = F.concat(F.lit("Inspect document condition regarding: "), risk)
        for name, said in says.items():
            out = F.when(risk == name, said).otherwise(out)
        return out

    return F.transform(risks, entry)


def rescan_decision(fatal: Column, risks: Column, sparse: Column) -> Column:
    v = verdict(fatal, risks)
    return F.when(F.size(fatal) > 0, "RESCAN").when(sparse, "HUMAN_REVIEW").when(v == "GOOD", "CONTINUE").when((v == "ACCEPTABLE") & (F.size(risks) <= 1), "CONTINUE").otherwise("HUMAN_REVIEW")


def usability(lap: Column, score: Column, blurred: Column, clipped: Column, crop_ready: Column) -> Column:
    return F.when((lap < 35) | ((score < 40) & blurred) | clipped | ~crop_ready, "RESCAN_REQUIRED").otherwise("PASSED")


def readiness(ambiguous: Column, collision: Column, rotated: Column, pitch_ratio: Column) -> Column:
    return F.when(ambiguous, "ORIENTATION_AMBIGUOUS").when(collision > 0.15, "NOT_READY").when(rotated, "CONDITIONAL").when((pitch_ratio >= 2.2) & (collision < 0.08), "HTR_READY").otherwise("CONDITIONAL")


def feedback_eligibility(blurred: Column, unclear: Column, agreement: Column, n_chars: Column) -> Column:
    return F.when(blurred | unclear, "DISQUALIFIED").when((agreement < 0.90) | (n_chars < 15), "AUDIT_ONLY").otherwise("QUALIFIED")


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Boxes as x0, y0, x1, y1."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    both = side(0, 2) * side(1, 3)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return both / (area(a) + area(b) - both + 1e-6)
