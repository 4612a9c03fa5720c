"""Planned corrections of a page grid, each verified before it is kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# At most so many steps; the least gains, and the largest growth of noise, for which a step is kept.
MAX_STEPS, LEAST_SHADOW_GAIN, LEAST_CONTRAST_GAIN, MOST_NOISE = 5, 10.0, 15.0, 1.6
SHADOW_DEFICIT, LOW_CONTRAST = 45.0, 52.0


def _regions(g: np.ndarray) -> np.ndarray:
    side = g.shape[0] // 4
    return np.array([[np.percentile(g[y : y + side, x : x + side], 85) for x in range(0, g.shape[1], side)] for y in range(0, g.shape[0], side)])


def deficit(g: np.ndarray) -> float:
    r = _regions(g)
    return float(r.max() - r.min())


def contrast(g: np.ndarray) -> float:
    return float(np.percentile(g, 90) - np.percentile(g, 10))


def noise(g: np.ndarray) -> float:
    return float(1.4826 * np.median(np.abs(g - np.median(g))))


def even_out(g: np.ndarray) -> np.ndarray:
    r = _regions(g)
    background = np.kron(r, np.ones((g.shape[0] // 4, g.shape[1] // 4)))
    return np.clip(g + (r.max() - background), 0, 255)


def stretch(g: np.ndarray) -> np.ndarray:
    low, high = np.percentile(g, 1), np.percentile(g, 99)
    return np.clip((g - low) * 255 / (high - low), 0, 255) if high - low > 1e-9 else g


#: Name, whether it is needed, the step, and whether the result is worth keeping; in the order of planning.
STEPS = (
    ("SHADOW", lambda g: deficit(g) > SHADOW_DEFICIT, even_out, lambda a, b: deficit(a) - deficit(b) >= LEAST_SHADOW_GAIN and noise(b) <= MOST_NOISE * max(1.0, noise(a))),
    ("CONTRAST", lambda g: contrast(g) < LOW_CONTRAST, stretch, lambda a, b: contrast(b) - contrast(a) >= LEAST_CONTRAST_GAIN and deficit(b) <= max(SHADOW_DEFICIT, 4 * deficit(a))),
)


def correct(g: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The corrected grid and what was done: each step is tried once, kept or rolled back, until none is needed."""
    tried: set[str] = set()
    log: list[str] = []
    for _ in range(MAX_STEPS):
        step = next((s for s in STEPS if s[0] not in tried and s[1](g)), None)
        if step is None:
            break
        name, _, run, worth = step
        tried.add(name)
        new = run(g)
        if worth(g, new):
            g = new
            log.append(f"{name}:COMMITTED")
        else:
            log.append(f"{name}:ROLLED_BACK")
    return g, log


def corrected_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``steps`` (comma-joined), and deficit and contrast before and after; pages are corrected one by one in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, grid in zip(batch["page_id"], batch["grid"], strict=True):
                before = np.asarray(grid, float).reshape(int(len(grid) ** 0.5), -1)
                after, log = correct(before)
                rows.append((page, ",".join(log), *[round(f(g), 6) for f in (deficit, contrast) for g in (before, after)]))
            yield pd.DataFrame(rows, columns=["page_id", "steps", "deficit_before", "deficit_after", "contrast_before", "contrast_after"])

    return pages.where("grid is not null").select("page_id", "grid").mapInPandas(run, "page_id long, steps string, deficit_before double, deficit_after double, contrast_before double, contrast_after double")
