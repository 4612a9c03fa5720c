"""Timers and stale views over the event bus: jobs that hear nothing in time expire, and events name the views they make stale."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# How long is waited, in milliseconds, for a set of scorers, for one question, for a look at a page.
ENSEMBLE, QUESTION, VISION = 4_000, 90_000, 30_000
# Views that each event makes stale.
STALE = {
    "script.finalized": ("monitoring-books",),
    "answerbook.assigned": ("monitoring-books", "monitoring-evaluations"),
    "answerbook.status.changed": ("monitoring-books",),
    "evaluation.started": ("monitoring-books", "monitoring-evaluations"),
    "evaluation.submitted": ("monitoring-books", "monitoring-evaluations"),
    "moderation.approved": ("monitoring-books", "monitoring-evaluations"),
    "moderation.returned": ("monitoring-books", "monitoring-evaluations"),
}


def _watch(wait_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (heard,) = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "outcome": ["EXPIRED"], "heard": [heard]})
            return
        heard, ended = state.get[0] if state.exists else 0, False
        for b in batches:
            heard += len(b)
            ended |= bool(b["final"].any())
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"job": [key[0]], "outcome": ["ENDED"], "heard": [heard]})
        else:
            state.update((heard,))
            state.setTimeoutDuration(wait_ms)

    return step


def watched_jobs(events: DataFrame, wait_ms: int = QUESTION) -> DataFrame:
    """From rows of ``job`` and ``final``: one row for each job that ends (a final event) or expires (``wait_ms`` without any event).

    ``heard`` counts its events. Each event sets the timer anew; timers are kept with the state, so one that ran out while the
    stream was down fires in the first trigger after a restart (which an event of any job sets off). A job that is heard of again begins anew. A null ``final`` is none.
    """
    rows = events.select(F.col("job").cast("string").alias("job"), F.coalesce("final", F.lit(False)).alias("final"))
    return rows.groupBy("job").applyInPandasWithState(_watch(wait_ms), "job string, outcome string, heard long", "heard long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stale_views(events: DataFrame) -> DataFrame:
    """``view``, ``scope`` (the exam, or null for all), ``events`` and ``since``: what has to be read again, once however many events name it.

    The mapping is a column expression, so nothing is joined. Events of other names make nothing stale. On a stream use
    the output mode ``update``: each trigger tells the views that it made stale.
    """
    views = F.create_map(*[x for name, of in STALE.items() for x in (F.lit(name), F.array(*map(F.lit, of)))])
    named = events.select(F.explode(views[F.col("event")]).alias("view"), "scope", "ts")
    return named.groupBy("view", "scope").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("since"))


def polled(stream: DataFrame, folder: str, seconds: int = 20):
    """A running query that reads again every ``seconds`` and keeps the whole result of each round as a table under ``folder``."""
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
    return stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(processingTime=f"{seconds} seconds").start()


def wait_until(holds, seconds: float) -> bool:
    """Whether ``holds()`` came true in time; looked at ten times a second."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if holds():
            return True
        time.sleep(0.1)
    return bool(holds())
