"""Corrections of whole pages as transactions: planned from what a page shows, proved against it, kept or taken back.

A page begins as version 0. While no fatal defect is seen, the first step that the page calls for (shadow before contrast,
each at most once) makes a candidate; gates compare it with the version it came from. If all of them hold it becomes the next
version, otherwise that version stays and the step is spent. Pages are corrected one by one in the Arrow batches that Spark deals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import passes
from . import page_images, rasters
from .page_images import PAGE, Page, components, dilated
from .vision import FATAL


class Limits(NamedTuple):
    """Fixed values of gates, triggers and kernels."""

    most_rounds: int = 5
    least_change: float = 0.5
    least_edges: int = 40
    survival: float = 0.80
    faint_loss: float = 0.15
    faint_from: float = 10.0
    faint_to: float = 35.0
    halo: float = 15.0
    regions: float = 0.20
    contrast_regions: float = 0.25
    noise: float = 3.0
    contrast_noise: float = 8.0
    remedy: float = 10.0
    contrast_gain: float = 15.0
    shadow_ratio: float = 0.68
    shadow_deficit: float = 40.0
    shadow_ratio_deep: float = 0.60
    shadow_spread: float = 25.0
    strong_contrast: float = 70.0
    few_faint: float = 0.10
    low_contrast: float = 55.0
    many_faint: float = 0.20
    shadow_kernel: int = 31
    shadow_blur: float = 0.75
    background_kernel: int = 25


LIMITS = Limits()
MEASURES = ("survival", "faint_loss", "halo", "regions", "noise", "drift", "contrast_gain", "acutance_gain")


def _odd(x: float, least: int, most: int = 1 << 30) -> int:
    return max(least, min(most, int(round(x)) | 1))


class Look(Page):
    """A page and what planning and proof look at besides its measures."""

    @property
    def scale(self) -> float:
        return min(self.width, self.height) / 1000.0

    @cached_property
    def strokes_near(self) -> np.ndarray:
        """Strokes against the paper around them."""
        return rasters.adaptive_ink(self.grey, _odd(min(self.width, self.height) * 0.03, 15), 10)

    @cached_property
    def depth(self) -> np.ndarray:
        """How much darker each pixel is than the lightest around it."""
        return rasters.dilated_grey(self.grey, _odd(LIMITS.background_kernel * self.scale, 11)).astype(np.int16) - self.grey

    @cached_property
    def beside_strokes(self) -> np.ndarray:
        return dilated(self.strokes_near, 5) & ~self.strokes_near

    @cached_property
    def range(self) -> float:
        return rasters.level_at(self.histogram, 0.99) - rasters.level_at(self.histogram, 0.01)

    @cached_property
    def paper(self) -> float:
        return rasters.level_at(self.histogram, 0.85)

    @cached_property
    def stroke_level(self) -> float:
        n = np.bincount(self.grey.ravel().take(np.flatnonzero(self.strokes_near)), minlength=256)
        return rasters.level_at(n, 0.25) if n.sum() else 0.0

    def stroke_contrast(self) -> tuple[float, float]:
        """Middle depth of strokes and the share of faint ones; a page with hardly any calls for nothing."""
        n = np.bincount(self.depth.ravel().take(np.flatnonzero(self.strokes_near)), minlength=256)
        if n.sum() <= 50:
            return 100.0, 0.0
        return rasters.level_at(n, 0.5), float(n[int(LIMITS.faint_from) : int(LIMITS.faint_to) + 1].sum() / n.sum())


class Pair:
    """A version and the candidate made from it."""

    def __init__(self, step: str, before: Look, after: Look) -> None:
        self.step, self.before, self.after = step, before, after

    @property
    def stretches(self) -> bool:
        return self.step == "CONTRAST_NORMALIZATION"

    @cached_property
    def gain(self) -> float:
        """How far levels were drawn apart on purpose: gradients may grow as much."""
        return max(1.0, self.after.range / self.before.range) if self.stretches and self.before.range > 10.0 else 1.0

    # Measures.

    def survival(self) -> float:
        """Share of edge pixels that have one within a pixel afterwards."""
        return float(np.count_nonzero(self.before.line & dilated(self.after.line, 3)) / max(1, self.before.n_line))

    def faint_loss(self) -> float:
        depth = self.before.depth
        faint = self.before.strokes_near & (depth >= LIMITS.faint_from) & (depth <= LIMITS.faint_to)
        n = int(faint.sum())
        return 1.0 - float((faint & self.after.strokes_near).sum() / n) if n > 30 else 0.0

    def halo(self) -> float:
        """Growth of gradients beside strokes, beyond what drawing levels apart explains."""
        beside = self.before.beside_strokes
        return float(self.after.slope[beside].mean() - self.gain * self.before.slope[beside].mean()) if beside.sum() > 50 else 0.0

    def regions(self) -> float:
        """Regions of strokes afterwards for each before; specks under 4 pixels aside."""
        count = lambda p: max(1, int((components(p.strokes_near).area >= 4).sum()))
        return count(self.after) / count(self.before)

    def noise(self) -> float:
        """Growth of the deviation of paper away from strokes."""
        flat = ~self.before.beside_strokes & ~self.before.strokes_near
        return float(self.after.grey[flat].std() - self.before.grey[flat].std()) if flat.sum() > 100 else 0.0

    def drift(self) -> float:
        return self.after.paper - self.before.paper

    def contrast_gain(self) -> float:
        return (self.after.paper - self.after.stroke_level) - (self.before.paper - self.before.stroke_level)

    def acutance_gain(self) -> float:
        sharp = lambda p: p.line_slope if p.n_line else 0.0
        return sharp(self.after) - sharp(self.before)


def _limit(pair: Pair, plain: float, stretching: float) -> float:
    return max(plain, stretching) if pair.stretches else plain


#: Name and whether it fails, from a pair and its measures; in order.
GATES: tuple[tuple[str, Callable[[Pair, dict[str, float]], bool]], ...] = (
    ("STROKES_LOST", lambda p, m: m["survival"] < LIMITS.survival),
    ("FAINT_STROKES_LOST", lambda p, m: m["faint_loss"] > LIMITS.faint_loss),
    ("HALO", lambda p, m: m["halo"] > LIMITS.halo * (1 + 0.25 * p.before.scale)),
    ("FRAGMENTED", lambda p, m: abs(m["regions"] - 1) > _limit(p, LIMITS.regions, LIMITS.contrast_regions)),
    ("NOISE", lambda p, m: m["noise"] > _limit(p, LIMITS.noise, LIMITS.contrast_noise * (1 + 0.25 * p.before.scale))),
    ("SHADOW_REMAINS", lambda p, m: p.step == "SHADOW_NORMALIZATION" and page_images.background_deficit(p.before) - page_images.background_deficit(p.after) < LIMITS.remedy),
    ("CONTRAST_REMAINS", lambda p, m: p.stretches and m["contrast_gain"] < LIMITS.contrast_gain),
)


def proved(step: str, before: Look, after: np.ndarray) -> tuple[str, list[str], dict[str, float]]:
    """Verdict, reasons and measures of a candidate. A change that is hardly one fails; a page with hardly any edges proves nothing."""
    if np.abs(after.astype(np.int16) - before.grey).mean() < LIMITS.least_change:
        return "FAIL", ["NO_CHANGE"], {}
    if before.n_line < LIMITS.least_edges:
        return "INSUFFICIENT_EVIDENCE", ["FEW_STROKES"], {}
    pair = Pair(step, before, Look(after))
    measures = {m: getattr(pair, m)() for m in MEASURES}
    reasons = [name for name, fails in GATES if fails(pair, measures)]
    return "FAIL" if reasons else "PASS", reasons, measures


class Step(NamedTuple):
    """A correction: the condition it answers, its place in the order, whether a page calls for it, and what it does (never in place)."""

    name: str
    condition: str
    priority: int
    called_for: Callable[[Look], bool]
    run: Callable[[Look], np.ndarray]


def _shaded(p: Look) -> bool:
    ratio = page_images.background_ratio(p)
    deep = ratio < LIMITS.shadow_ratio and page_images.background_deficit(p) >= LIMITS.shadow_deficit
    return deep or (ratio < LIMITS.shadow_ratio_deep and page_images.background_std(p) >= LIMITS.shadow_spread)


def _evened(p: Look) -> np.ndarray:
    side = _odd(LIMITS.shadow_kernel * p.scale, 11, 61)
    return rasters.evened(p.grey, side, _odd(side * LIMITS.shadow_blur, 3))


def _weak(p: Look) -> bool:
    contrast, faint = p.stroke_contrast()
    return not (contrast >= LIMITS.strong_contrast and faint < LIMITS.few_faint) and (contrast < LIMITS.low_contrast or faint >= LIMITS.many_faint)


REGISTRY: dict[str, Step] = {}


def register(step: Step) -> Step:
    """Makes a step known; one of the same name is replaced."""
    REGISTRY[step.name] = step
    return step


register(Step("SHADOW_NORMALIZATION", "ILLUMINATION_SHADOW", 10, _shaded, _evened))
register(Step("CONTRAST_NORMALIZATION", "LOW_STROKE_CONTRAST", 20, _weak, lambda p: rasters.stretched(p.grey, least=15.0)))


def is_fatal(p: Page) -> bool:
    """Whether the page shows a defect that no correction mends."""
    measured = ((k, page_images.MEASURES[k](p), limit) for k, limit in FATAL.items())  # one at a time: the first defect settles it
    return any(e < limit if k in ("acutance", "stroke_contrast") else e > limit for k, e, limit in measured)


class Tried(NamedTuple):
    step: str
    version: int  # of the page after it
    parent: int
    verdict: str
    reasons: list[str]
    measures: dict[str, float]


def corrected(grey: np.ndarray, registry: dict[str, Step] | None = None) -> tuple[np.ndarray, str, list[Tried]]:
    """The last version, how it ended (FATAL, CLEAN: nothing was called for, CORRECTED, KEPT: all was taken back) and every step tried."""
    now, version, tried, spent = Look(grey), 0, [], set()
    if is_fatal(now):
        return grey, "FATAL", []
    steps = sorted((registry or REGISTRY).values(), key=lambda s: (s.priority, s.name))
    for _ in range(LIMITS.most_rounds):
        step = next((s for s in steps if s.name not in spent and s.called_for(now)), None)
        if step is None:
            break
        spent.add(step.name)
        candidate = step.run(now)
        verdict, reasons, measures = proved(step.name, now, candidate)
        tried.append(Tried(step.name, version + (verdict == "PASS"), version, verdict, reasons, measures))
        if verdict == "PASS":
            now, version = Look(candidate), version + 1
    return now.grey, "CORRECTED" if version else "KEPT" if tried else "CLEAN", tried


_TRIED = "array<struct<step: string, version: int, parent: int, verdict: string, reasons: array<string>, " + ", ".join(f"{m}: double" for m in MEASURES) + ">>"


def correction_step() -> passes.Step:
    """:func:`corrected_pages` as a step; sides are 32-bit numbers."""
    fields = [("step", pa.string()), ("version", pa.int32()), ("parent", pa.int32()), ("verdict", pa.string()), ("reasons", pa.list_(pa.string())), *[(m, pa.float64()) for m in MEASURES]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, logs, out = [], [], []
            for w, h, pixels in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if None in (w, h, pixels) or len(pixels) != w * h or min(w, h) < 8:
                    ends.append("UNREADABLE"), logs.append(None), out.append(None)
                    continue
                page, end, tried = corrected(np.frombuffer(pixels, np.uint8).reshape(h, w))
                ends.append(end), out.append(page.tobytes())
                logs.append([t._asdict() | {m: round(t.measures[m], 6) if m in t.measures else None for m in MEASURES} for t in tried])
            kinds = pa.list_(pa.struct(fields))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.string()), pa.array(logs, kinds), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["page_id", "outcome", "tried", "width", "height", "pixels"])

    return passes.Step(run, PAGE, f"outcome string, tried {_TRIED}, width int, height int, pixels binary")


def corrected_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``outcome``, ``tried`` (a record for each step) and the last version as ``width``, ``height``, ``pixels``.

    A page without its pixels has nulls and the outcome UNREADABLE. Measures are rounded to 6 places.
    """
    return passes.through(pages.selectExpr("page_id", "cast(width as int) as width", "cast(height as int) as height", "pixels"), correction_step())
