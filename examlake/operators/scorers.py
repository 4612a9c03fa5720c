"""Scorers from outside: named batch functions with a time limit, given only the rows that nothing else resolved."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes ``page_id``, ``question``, ``page_text``, ``question_text``; gives as many confidences and pieces of evidence.
Batch = Callable[[pd.DataFrame], pd.DataFrame]
# The least confidence that a match from outside is kept for, and how many seconds are waited for a batch.
LEAST_CONFIDENCE, SECONDS = 0.65, 30.0


class Scorer(NamedTuple):
    name: str
    score: Batch
    seconds: float
    rows: int


REGISTRY: dict[str, Scorer] = {}


def register(name: str, score: Batch, seconds: float = SECONDS, rows: int = 64) -> Scorer:
    """Makes a scorer known: ``score`` gets at most ``rows`` rows and is waited for ``seconds``. None is known from the start."""
    REGISTRY[name] = Scorer(name, score, seconds, rows)
    return REGISTRY[name]


def scored(rows: DataFrame, scorer: Scorer | str) -> DataFrame:
    """``page_id``, ``question``, ``confidence``, ``evidence`` and ``outcome``: SCORED, LATE or FAILED (then nulls) for each row.

    Batches run one at a time in a task; a late batch gives its rows their outcome and the next one begins at once.
    A confidence is cut to 0 to 1; none is FAILED.
    """
    scorer = REGISTRY[scorer] if isinstance(scorer, str) else scorer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), scorer.rows):
                some = whole.iloc[at : at + scorer.rows].reset_index(drop=True)
                out = some[["page_id", "question"]].assign(confidence=None, evidence=None, outcome="FAILED")
                pool = ThreadPoolExecutor(1)
                try:
                    found = pool.submit(scorer.score, some).result(scorer.seconds)
                    confidence = pd.to_numeric(found["confidence"], errors="coerce").clip(0, 1).to_numpy()
                    out = out.assign(confidence=confidence, evidence=found["evidence"].astype(object).to_numpy(), outcome=["FAILED" if c != c else "SCORED" for c in confidence])
                except Late:
                    out["outcome"] = "LATE"
                except Exception:  # noqa: BLE001  a scorer's own failure is a result
                    pass
                pool.shutdown(wait=False, cancel_futures=True)
                yield out

    kinds = dict(rows.dtypes)
    return rows.select("page_id", "question", "page_text", "question_text").mapInPandas(run, f"page_id {kinds['page_id']}, question {kinds['question']}, confidence double, evidence string, outcome string")


def with_fallback(mapped: DataFrame, pages: DataFrame, questions: DataFrame, scorer: Scorer | str | None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``mapped`` (``book``, ``page_id``, ``question``, ``confidence``, ``source``) with matches from outside for questions that have no page.

    ``pages``: ``book``, ``page_id``, ``page_text``; ``questions``: ``book``, ``question``, ``question_text``. Only unresolved questions
    meet the pages of their own book. Matches under ``least`` are left out. Without a scorer ``mapped`` is returned as it is. Null texts
    are empty; a page without any text is not asked about.
    """
    columns = ["book", "page_id", "question", "confidence", "source"]
    if scorer is None:
        return mapped.select(*columns)
    open_ = questions.join(mapped.select("book", "question").distinct(), ["book", "question"], "left_anti")
    seen = pages.where(F.trim(F.coalesce("page_text", F.lit(""))) != "")
    asked = open_.join(seen, "book").select("book", F.struct("book", "page_id").alias("page_id"), "question", "page_text", F.coalesce("question_text", F.lit("")).alias("question_text"))
    book, page = dict(pages.dtypes)["book"], dict(pages.dtypes)["page_id"]
    found = scored(asked.withColumn("page_id", F.to_json("page_id")), scorer).where(F.col("confidence") >= least)
    parts = F.from_json("page_id", f"book {book}, page_id {page}")
    return mapped.select(*columns).unionByName(found.select(parts.alias("p"), "question", "confidence").select("p.book", "p.page_id", "question", "confidence", F.lit("AUTO_MULTIMODAL").alias("source")))
