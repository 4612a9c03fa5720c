"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    ``spark.checkpoint.dir`` decides. Only where it is unset and everything runs in one process (tests,
    a laptop) a temporary folder is taken; on a cluster an unset folder is an error, as executors would
    write to disks of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="examlake-ckpt-")
        sc.setCheckpointDir(folder)


def fresh_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager checkpoint in the shared folder."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving free memory back to the system at a task's end: workers live on, and the next stage's need room."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return wrapped


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_in_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """Sort ``df`` into key ranges; adds ``part`` and ``at`` (place in the part, from 0).

    The result is checkpointed, so each reader sees the same ranges, however the
    range bounds were sampled. Keep ``df`` narrow: it is written once.
    """
    n = n_partitions(df.sparkSession)
    sorted_ = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .drop("_tie")
    )
    seq = F.monotonically_increasing_id()
    return checkpointed(sorted_.withColumns({"part": F.shiftright(seq, 33).cast("int"), "at": seq.bitwiseAND((1 << 33) - 1)}))


def part_offsets(ranked: DataFrame, total: str) -> DataFrame:
    """Exclusive prefix sums by part: ``rows_before``, ``total_before``; and the grand ``total``.

    One row for each part, so the window over all of them is bounded by the number of partitions.
    """
    by_part = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.sum(total).alias("_t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return by_part.select(
        "part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("total_before"),
        F.sum("_t").over(everything).alias("total"),
    )


#: Hashes of ids are compared in this many steps, so a share of rows is exact to one in 4e18.
_STEPS = 1 << 62


def hash_limit(total: int, max_rows: int) -> int:
    """The hash (below ``_STEPS``) under which about ``max_rows`` of ``total`` rows lie; all of them where there are no more."""
    return _STEPS if total <= max_rows else _STEPS * max_rows // total


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Texts and labels of at most about ``max_rows`` training rows (crc32 of the id mod 5 is not 0).

    The rows are those of least hash, so the same for the same table, however large it is. Their ids are few
    enough to broadcast, so texts are not moved. An id that has both labels gives a row for each of them.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).select("doc_id", F.col(label).cast("int").alias(label)).distinct()
    usable = usable.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.lit(hash_limit(usable.count(), max_rows)))
    return docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(usable), "doc_id")  # max_rows ids
