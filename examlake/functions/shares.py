"""How many tasks a large table is dealt to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks for each part of a table that is read: a part is at most what spark.sql.files.maxPartitionBytes says, before it is unpacked.
SHARES = 8


def n_shares(rows: DataFrame) -> int:
    """How many tasks the rows of a table are dealt to: as many as the session shuffles into, and more for a large table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), SHARES * rows.rdd.getNumPartitions())
