"""Boxes, corners and clusters of page regions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp, first_failure


def ordered_corners(corners: Column) -> Column:
    """Corners by their angle around the centre, starting at the upper left quarter."""
    cx = F.aggregate(corners, F.lit(0.0), lambda s, c: s + c.x) / F.size(corners)
    cy = F.aggregate(corners, F.lit(0.0), lambda s, c: s + c.y) / F.size(corners)
    return F.transform(F.array_sort(F.transform(corners, lambda c: F.struct(F.atan2(c.y - cy, c.x - cx).alias("angle"), c.x.alias("x"), c.y.alias("y")))), lambda c: F.struct(c.x.alias("x"), c.y.alias("y")))


def corner_distances(a: Column, b: Column) -> Column:
    """Struct of the mean and the largest distance between corners of the same place."""
    d = F.zip_with(a, b, lambda p, q: F.hypot(p.x - q.x, p.y - q.y))
    return F.struct((F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)).alias("mean_distance"), F.array_max(d).alias("max_distance"))


def quadrilateral_problem(corners: Column, width: Column, height: Column) -> Column:
    """The first reason why four corners are no page; null for a page.

    Its area is 0.12 to 0.85 of the frame, corners leave the frame by 8 pixels at most and fewer than three
    lie within 12 of its border, mean sides are 25 or more and 0.25 to 4 to each other, angles are 55 to 125 degrees.
    """
    outside = F.exists(corners, lambda c: (c.x < -8) | (c.y < -8) | (c.x > width + 8) | (c.y > height + 8))
    touching = F.size(F.filter(corners, lambda c: (c.x <= 12) | (c.y <= 12) | (c.x >= width - 12) | (c.y >= height - 12)))

    def of_sides(q: Column) -> Column:
        at = lambda i: F.get(q, F.lit(i % 4))
        area = F.abs(sum((at(i).x * at(i + 1).y - at(i + 1).x * at(i).y for i in range(4)), F.lit(0.0))) / 2
        sides = F.array(*[F.hypot(at(i + 1).x - at(i).x, at(i + 1).y - at(i).y) for i in range(4)])
        dots = F.array(*[(at(i + 3).x - at(i).x) * (at(i + 1).x - at(i).x) + (at(i + 3).y - at(i).y) * (at(i + 1).y - at(i).y) for i in range(4)])
        return F.struct((area / (width * height)).alias("share"), sides.alias("sides"), dots.alias("dots"))

    def problem(m: Column) -> Column:
        side = lambda i: F.get(m.sides, F.lit(i % 4))
        across, down = (side(0) + side(2)) / 2, (side(1) + side(3)) / 2
        aspect = across / F.greatest(F.lit(1.0), down)
        angles = F.transform(m.dots, lambda d, i: F.degrees(F.acos(clamp(F.coalesce(F.try_divide(d, F.get(m.sides, i) * F.get(m.sides, (i + 3) % 4)), F.lit(1.0)), -1.0, 1.0))))
        return first_failure(
            (F.coalesce(F.size(corners), F.lit(0)) != 4, "NOT_FOUR_CORNERS"), (m.share < 0.12, "TOO_SMALL"), (m.share > 0.85, "TOO_LARGE"), (outside, "OUT_OF_FRAME"), (touching >= 3, "FRAME_BORDER"), ((across < 25) | (down < 25), "SHORT_SIDES"),
            ((aspect < 0.25) | (aspect > 4.0), "BAD_ASPECT"), (F.exists(m.sides, lambda s: s < 1e-4), "DEGENERATE"), (F.exists(angles, lambda a: (a < 55) | (a > 125)), "BAD_ANGLE"),
        )

    # A lambda over one element holds a value that is used many times; plain columns would sort the corners at each use.
    measured = F.transform(F.array(ordered_corners(corners)), of_sides)
    return F.get(F.transform(measured, problem), F.lit(0))


def _iou(a: tuple, b: tuple) -> float:
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both + 1e-6)


def _near(a: tuple, b: tuple) -> float:
    """Mean distance of corners of the same place."""
    return sum(math.hypot(a[i] - b[i], a[j] - b[j]) for i in (0, 2) for j in (1, 3)) / 4


def greedy_boxes(boxes: DataFrame, least_iou: float = 0.90, most_distance: float = math.inf) -> DataFrame:
    """Per page, in ascending ``box``: the first box of a look-alike set stays, later ones go with it (``kept_by``).

    Look-alike: overlap of ``least_iou`` or more with it, and corners within ``most_distance`` on average.

    Order decides, so a page's boxes are walked in turn; pages are dealt whole and sorted, and
    batches are walked without a group call for each page. ``boxes``: ``page_id``, ``box``, ``x0``,
    ``y0``, ``x1``, ``y1``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, kept = None, []
        for batch in batches:
            by = []
            for at, box, *corners in batch.itertuples(index=False, name=None):
                if at != page:
                    page, kept = at, []
                first = next((k for k, xy in kept if _iou(xy, corners) >= least_iou and _near(xy, corners) <= most_distance), None)
                if first is None:
                    kept.append((box, corners))
                by.append(box if first is None else first)
            yield pd.DataFrame({"page_id": batch["page_id"], "box": batch["box"], "kept_by": by})

    dealt = boxes.select("page_id", "box", "x0", "y0", "x1", "y1").repartition("page_id").sortWithinPartitions("page_id", "box", "x0", "y0", "x1", "y1")
    return dealt.mapInPandas(run, "page_id long, box long, kept_by long")


def hysteresis(moves: DataFrame, key: str, order: str, movement: str, limit: float = 0.08) -> DataFrame:
    """Stable-frame counter: up to 3 after small movements, down to 1 after large ones, 0 where detection is lost (null); ready at 2.

    The counter follows from the one before: a camera's frames are dealt to one task in order and walked
    batch by batch, so none is held whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, level = None, 0
        for frames in batches:
            out = []
            for who, _, m in frames.itertuples(index=False, name=None):
                if who != camera:
                    camera, level = who, 0
                level = 0 if pd.isna(m) else min(3, level + 1) if m < limit else max(1, level - 1)
                out.append(level)
            yield frames[[key, order]].assign(stable_frames=out, ready=[x >= 2 for x in out])

    types = dict(moves.dtypes)
    dealt = moves.select(key, order, movement).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInPandas(run, f"`{key}` {types[key]}, `{order}` {types[order]}, stable_frames int, ready boolean")
