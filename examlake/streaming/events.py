"""The event bus with Structured Streaming: windows, duplicates, live counters and the status machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rules import BOOK_NEXT

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events read as they arrive under ``path``; the time as an instant, which watermarks need."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 8).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _timely(events: DataFrame, delay: str) -> DataFrame:
    """On a stream, events later than ``delay`` behind the newest are dropped, which bounds what is kept; a table has all."""
    return events.withWatermark("ts", delay) if events.isStreaming else events


def rate_limited(events: DataFrame, seconds: int = 60, limit: int = 120, delay: str = "1 day") -> DataFrame:
    """Windows in which a user sent more than ``limit`` events; the same on a table or a stream."""
    counts = _timely(events, delay).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("window_start"), "n")


def windowed(events: DataFrame, width: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Events of each type by window, and how many users they come from: ``users`` on a table, ``about_users`` on a stream, which cannot count them exactly."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    users = F.approx_count_distinct("user_id").alias("about_users") if events.isStreaming else F.count_distinct("user_id").alias("users")
    counts = _timely(events, delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), users)
    return counts.select("event_type", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", counts.columns[-1])


def sessions(events: DataFrame, gap: str, delay: str = "1 day") -> DataFrame:
    return _timely(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once_each(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops redeliveries of an event id that arrive within ``delay`` of each other."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


# The status that each event puts a book into.
STATE_OF = {"signup": "READY", "view": "ASSIGNED", "click": "IN_PROGRESS", "purchase": "SUBMITTED", "error": "RETURNED"}


_STATES = list(BOOK_NEXT)
_ILLEGAL = np.array([[a != b and b not in BOOK_NEXT[a] for b in _STATES] for a in _STATES])
_CODE = {event: _STATES.index(status) for event, status in STATE_OF.items()}
_OTHER = _STATES.index("RETURNED")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, at, event_id, seen, illegal, late = state.get if state.exists else (None, None, None, 0, 0, 0)
    # A key's rows of a trigger come in several batches of no order between them; three numbers of each row are held.
    parts = [(b["at"].to_numpy(np.int64), b["event_id"].to_numpy(np.int64), b["event_type"].map(_CODE).fillna(_OTHER).to_numpy(np.int8)) for b in batches]
    ats, ids, codes = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, ats))
    seen += len(order)
    if status is not None:
        fresh = (ats[order] > at) | ((ats[order] == at) & (ids[order] > event_id))
        late += int((~fresh).sum())
        order = order[fresh]
    if len(order):
        steps = codes[order] if status is None else np.concatenate(([_STATES.index(status)], codes[order]))
        illegal += int(_ILLEGAL[steps[:-1], steps[1:]].sum())
        status, at, event_id = _STATES[steps[-1]], int(ats[order[-1]]), int(ids[order[-1]])
    state.update((status, at, event_id, seen, illegal, late))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "n_events": [seen], "n_illegal": [illegal], "n_late": [late]})


def status_machine(events: DataFrame) -> DataFrame:
    """Status of each book after its latest event by (ts, event_id), events so far and illegal steps, kept as state by key.

    Steps are judged in time order over all rows of a trigger. An event that comes in a later trigger than a later one
    is counted in ``n_events`` and ``n_late``; it neither changes the status nor is its step judged.
    """
    counts = "n_events long, n_illegal long, n_late long"
    out, held = f"user_id long, status string, {counts}", f"status string, at long, event_id long, {counts}"
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(2**63)))  # an event of no time comes before all others
    rows = events.select("user_id", at.alias("at"), F.coalesce("event_id", F.lit(-(2**63))).alias("event_id"), "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(_step, out, held, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what has arrived and returns its rows as a table.

    Each batch overwrites its own folder, so a batch that is run again after a failure leaves no
    second copy. ``complete``: the last batch holds the whole result; ``update``: all batches do.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == (last if last is not None else -1)).drop("batch")
    return rows
