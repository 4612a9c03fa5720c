"""Connected components by contraction, for links kept as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links that one task joins up at the end; while more are left, rounds contract them. The components are the same either way.
LAST_LINKS = 500_000


def _join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pd.DataFrame({"at": nodes, "to": [find(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """``links`` (``a``, ``b``, long) -> ``node``, ``component`` (the smallest node reachable).

    In each round every node moves to its neighbour (or itself) of the least hash, and links are
    carried over, so a component shrinks by a constant factor on average; chains of sorted ids do
    too, as hashes ignore their order. Once at most ``last_links`` are left, one task joins them up,
    which bounds it. Only links and places move, pre-aggregated; each round is checkpointed.
    """
    edges = checkpointed(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    place = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("at", F.col("node"))
    round_ = 0
    while edges.count() > last_links:
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        best = checkpointed(both.groupBy(F.col("a").alias("at")).agg(F.least(F.min(rank("b")), F.min(rank("a"))).getField("v").alias("to")))
        place = checkpointed(place.join(best, "at", "left").select("node", F.coalesce("to", "at").alias("at")))
        moved = edges.join(best.select(F.col("at").alias("a"), F.col("to").alias("ta")), "a").join(best.select(F.col("at").alias("b"), F.col("to").alias("tb")), "b")
        edges = checkpointed(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        round_ += 1
    best = edges.coalesce(1).mapInPandas(_join_up, "at long, to long")
    place = checkpointed(place.join(best, "at", "left").select("node", F.coalesce("to", "at").alias("at")))
    if not round_:  # the last task's own places are the least nodes
        return place.withColumnRenamed("at", "component")
    least = place.groupBy("at").agg(F.min("node").alias("component"))
    return place.join(least, "at").select("node", "component")
