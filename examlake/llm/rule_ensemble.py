"""Quality classifier: a sparse ensemble of rules taken from trees.

Shallow trees are grown on text statistics; each path from a root becomes a conjunctive
rule; a lasso logistic regression over the rules keeps few of them; and those are compiled
into one Spark column expression, so scoring is a projection over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, labelled_rows
from .quality_rules import quality_stats

#: Labelled training rows at most; chosen by a hash of the id.
MAX_ROWS = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.002
STATS = ("n_words", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "ellipsis_line_ratio", "upper_ratio", "distinct_word_ratio", "repeat_word_ratio")

#: (statistic, whether above the threshold, threshold)
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleEnsemble:
    """Conjunctive rules with their weights, and the intercept."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def margin(self, stat) -> Column:
        """The weighted sum of rules; ``stat`` gives the column of a statistic's name."""
        return reduce(lambda s, r: s + F.when(holds(r[0], stat), F.lit(r[1])).otherwise(0.0), self.rules, F.lit(self.intercept))


def holds(conditions: tuple[Condition, ...], stat) -> Column:
    tests = [stat(name) > F.lit(at) if above else stat(name) <= F.lit(at) for name, above, at in conditions]
    return reduce(lambda a, b: a & b, tests)


def paths(node, above: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Every path from the root of a fitted tree, as conditions; one bound per side of a statistic."""
    found = [above] if above else []
    if node.getClass().getSimpleName() == "LeafNode":
        return found
    split = node.split()
    name, at = STATS[split.featureIndex()], float(split.threshold())
    for child, side in ((node.leftChild(), False), (node.rightChild(), True)):
        kept = tuple(c for c in above if c[:2] != (name, side))
        found += paths(child, (*kept, (name, side, at)))
    return found


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, seed: int = 7) -> RuleEnsemble | None:
    """Fits on ``labels`` (``doc_id``, ``label``: 0 or 1) and the texts of ``docs``; None if a class is missing.

    At most about ``max_rows`` labelled rows are learnt from, chosen by a hash of the id. Where the
    trees find no split (very few rows, or equal texts), the model has no rules and its score is the
    share of label 1.
    """
    rows = labelled_rows(docs, labels, label, max_rows).withColumnRenamed(label, "_label")
    stats = quality_stats(rows).select(F.col("_label").cast("double").alias("label"), *[F.col(f"quality.{s}").cast("double").alias(s) for s in STATS])
    known = checkpointed(checkpointed(stats).coalesce(4))  # at most max_rows rows of numbers, read many times
    ones, n = known.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count(F.lit(1))).first()
    if not 0 < ones < n:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, maxBins=64, featureSubsetStrategy="0.6", subsamplingRate=0.7, seed=seed)
    model = forest.fit(VectorAssembler(inputCols=list(STATS), outputCol="features").transform(known))
    rules = sorted({tuple(sorted(p)) for tree in model.trees for p in paths(tree._java_obj.rootNode())})
    if not rules:
        return RuleEnsemble((), math.log(ones / (n - ones)))
    fired = known.select("label", array_to_vector(F.array(*[holds(r, F.col).cast("double") for r in rules])).alias("features"))
    fired = checkpointed(fired)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(fired)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return RuleEnsemble(tuple(weights), float(lasso.intercept))


def with_score(docs: DataFrame, model: RuleEnsemble | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, the chance (0 to 1) of label 1, for each whole text; a column of that name is replaced.

    A null or empty text is scored by its statistics, all 0. Without a model (no labels of both
    kinds) every score is 0.5, which the query and the pipeline keep: nothing is rejected where nothing
    was learnt. Equal texts get equal scores; no other column is read.
    """
    if model is None:
        return docs.withColumn(out_col, F.lit(0.5))
    stats = quality_stats(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text")))
    margin = model.margin(lambda name: F.col(f"quality.{name}").cast("double"))
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() != out_col.lower()]
    return stats.select(*kept, (1 / (1 + F.exp(-margin))).alias(out_col))
