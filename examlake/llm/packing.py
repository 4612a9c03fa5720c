"""Hierarchical residual packing of token sequences.

Each partition packs its own pieces best-fit (longest first) and emits its nearly full
bins. Underfull bins go up a tree as items: each node packs the bins of its children
best-fit again, emits those that are full enough and hands on the emptiest. Texts and
ids stay in the first pass; only lengths and bin numbers move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, n_partitions, releasing, text_or_empty
from .tokens import encoder

_PLACE = T.StructType([T.StructField("bin", T.LongType()), T.StructField("shift", T.IntegerType()), T.StructField("fill", T.IntegerType()), T.StructField("first", T.BooleanType())])
#: Texts whose new words go through the model together. Bounds memory, never results.
_RUN_CHARS = 1 << 21
_BIN = "group int, fill int, members array<struct<bin: bigint, shift: int>>, up boolean"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins, each a list of places in ``lengths``. Ties keep their order."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bin numbers by residual
    mask = 0  # bit r: some bin has residual r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := mask >> n:
            residual = n + (fits & -fits).bit_length() - 1
            b = open_at[residual].pop()
            if not open_at[residual]:
                mask ^= 1 << residual
            bins[b].append(i)
        else:
            b, residual = len(bins), capacity
            bins.append([i])
        if residual > n:
            open_at[residual - n].append(b)
            mask |= 1 << (residual - n)
    return bins


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about ``_RUN_CHARS`` characters; a longer text is a run of its own."""
    run, held = [], 0
    for text in texts:
        run.append(text.as_py())
        held += len(run[-1])
        if held >= _RUN_CHARS:
            yield run
            run, held = [], 0
    yield run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes each text, adds ``end_id`` and cuts what is longer than ``capacity``.

    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``. A null or empty text is the
    end id alone; a null id stays null; ids are handed on exactly, whatever their size.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer_path).texts_bytes, end_id.to_bytes(4, "little")
        for batch in batches:
            at, pieces = [], []
            for i, ids in enumerate(i + end for some in _runs(batch.column("_text")) for i in ids_of(some)):
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    at.append(i)
                    pieces.append((k, start // 4, len(part) // 4, zlib.crc32(part)))
            numbers = np.array(pieces, np.int64).reshape(-1, 4)
            ids_ = batch.column("_id").take(pa.array(at, pa.int64()))  # never as floats, whatever nulls stand beside
            yield pa.RecordBatch.from_arrays([ids_, pa.array(numbers[:, 0].astype(np.int32)), *[pa.array(numbers[:, c]) for c in (1, 2, 3)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    given = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    return given.mapInArrow(releasing(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048, nearly_full: float = 0.98, fan_in: int = 8, hand_on: int = 1024) -> DataFrame:
    """Packs rows with a ``length`` of 1 to ``capacity`` into sequences of ``capacity`` at most.

    Returns ``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence); columns
    of those two names are replaced, all others stay. Rows are dealt evenly to as many partitions as
    the session has for shuffles, so each sees all lengths, whatever their order and clustering; each
    packs its own. A node of the tree then packs the underfull bins of ``fan_in`` children as items and
    hands on its ``hand_on`` emptiest, which bounds what a task gets; the others are sequences as they
    stand, so no bin is lost. Every row is placed: equal and repeated rows are items of their own; an
    empty table gives an empty result. ``pieces`` should be narrow and the same when read again
    (checkpointed).
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("length").cast("int").alias("length"), F.monotonically_increasing_id().alias("deal"))
    dealt = rows.repartition(n_partitions(spark), "deal").select("row", "length", F.spark_partition_id().alias("part"))

    def locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held)
        lengths = part["length"].to_pylist()
        base, n = part["part"][0].as_py() << 32, part.num_rows
        bin_, shift, fill, first = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
        for b, items in enumerate(best_fit(lengths, capacity)):
            at = 0
            for i in items:
                bin_[i], shift[i] = base + b, at
                at += lengths[i]
            fill[items] = at
            first[items[0]] = True
        for name, values in (("bin", bin_), ("shift", shift), ("fill", fill), ("first", first)):
            part = part.append_column(name, pa.array(values))
        yield from part.to_batches(10_000)

    fields = T.StructType([*dealt.schema.fields, *_PLACE.fields])
    packed = checkpointed(dealt.mapInArrow(releasing(locally), fields))

    def merge(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        fills = bins["fill"].tolist()
        out = []
        for items in best_fit(fills, capacity):
            at, members = 0, []
            for i in items:
                members += [{"bin": m["bin"], "shift": m["shift"] + at} for m in bins["members"].iloc[i]]
                at += fills[i]
            out.append((key[0], at, members, at < nearly_full * capacity))
        out.sort(key=lambda x: x[1])
        return pd.DataFrame([(g, f, m, up and k < hand_on) for k, (g, f, m, up) in enumerate(out)], columns=["group", "fill", "members", "up"])

    emptiest = Window.partitionBy("part").orderBy("fill", "bin")
    level = packed.where(F.col("first") & (F.col("fill") < nearly_full * capacity)).withColumn("k", F.row_number().over(emptiest)).where(F.col("k") <= hand_on).select(
        F.col("part").alias("group"), "fill", F.array(F.struct("bin", F.lit(0).alias("shift"))).alias("members")
    )
    merged = None
    n_parts = packed.rdd.getNumPartitions()
    while n_parts > 1:
        n_parts = -(-n_parts // fan_in)
        node = level.withColumn("group", F.floor(F.col("group") / fan_in).cast("int"))
        level = checkpointed(node.groupBy("group").applyInPandas(merge, _BIN))
        done = level if n_parts == 1 else level.where(~F.col("up"))
        merged = done if merged is None else merged.unionByName(done)
        level = level.where("up").drop("up")
    if merged is None:
        sequence, offset = F.col("bin"), F.col("shift")
    else:
        moved = merged.select(F.explode("members").alias("m"), F.element_at("members", 1).getField("bin").alias("to")).select("m.bin", F.col("m.shift").alias("add"), "to")
        packed = packed.join(moved, "bin", "left")
        sequence, offset = F.coalesce("to", "bin"), F.col("shift") + F.coalesce("add", F.lit(0))
    return packed.select(*[F.col("row").getField(c).alias(c) for c in kept], sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, **options) -> DataFrame:
    """Tokenizes, cuts and packs ``docs``; see ``token_pieces`` and ``pack``."""
    return pack(checkpointed(token_pieces(docs, tokenizer_path, capacity)), capacity, **options)
