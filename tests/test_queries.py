"""Every registered query that has SQL gives the same rows in both engines, and the streams recover."""

import math
import os
import random

import duckdb
import pandas as pd
import pytest

from examlake.operators.rules import BOOK_NEXT
from examlake.plans import catalogue
from examlake.streaming import events

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(columns, want.fetchall())


def test_stream_keeps_state_over_restarts(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    half = rows.count() // 2
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.limit(half).coalesce(1).write.parquet(source)
    counts = lambda: {r.user_id: r.n_events for r in events.run_to_table(events.status_machine(events.event_stream(spark, source)), out, "update").groupBy("user_id").agg({"n_events": "max"}).withColumnRenamed("max(n_events)", "n_events").collect()}
    first = counts()
    assert sum(first.values()) == half
    rows.offset(half).coalesce(1).write.mode("append").parquet(source)
    assert sum(counts().values()) == rows.count()


def test_redeliveries_are_dropped(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").limit(50)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.union(rows).coalesce(1).write.parquet(source)
    assert events.run_to_table(events.once_each(events.event_stream(spark, source)), out, "append").count() == 50


def test_status_follows_time_over_batches_and_triggers(spark, tmp_path):
    """One user's events in 12 files of no order in time, read in two triggers; the first has several Arrow batches."""
    rng, kinds = random.Random(4), [*events.STATE_OF, "other"]
    rows = [(i, 1_700_000_000 + rng.randrange(9000), 1, rng.choice(kinds)) for i in range(24_000)]
    source = tmp_path / "in"
    source.mkdir()
    files = [rows[k * 2000 : (k + 1) * 2000] for k in range(12)]
    for k, part in enumerate(files):
        frame = pd.DataFrame(part, columns=["event_id", "ts", "user_id", "event_type"]).assign(value=0.0, props="{}")
        frame["ts"] = pd.to_datetime(frame["ts"], unit="s").astype("datetime64[us]")
        frame.to_parquet(source / f"{k:02}.parquet")
        os.utime(source / f"{k:02}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    got = events.run_to_table(events.status_machine(events.event_stream(spark, str(source))), str(tmp_path / "out"), "update").orderBy("batch").collect()
    status = lambda r: events.STATE_OF.get(r[3], "RETURNED")
    by_time = lambda rs: sorted(rs, key=lambda r: (r[1], r[0]))
    first = by_time([r for part in files[:8] for r in part])
    late = [r for part in files[8:] for r in part if (r[1], r[0]) < (first[-1][1], first[-1][0])]
    judged = first + by_time([r for part in files[8:] for r in part if (r[1], r[0]) > (first[-1][1], first[-1][0])])
    illegal = lambda rs: sum(status(a) != status(b) and status(b) not in BOOK_NEXT[status(a)] for a, b in zip(rs, rs[1:]))
    assert [(r.status, r.n_events, r.n_illegal, r.n_late) for r in got] == [(status(first[-1]), 16_000, illegal(first), 0), (status(by_time(rows)[-1]), 24_000, illegal(judged), len(late))]
