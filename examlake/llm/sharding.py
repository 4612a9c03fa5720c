"""Contiguous shards of near-equal byte size.

Rows are sorted by id into ranges; the byte total of each range gives its place in
the global prefix sum, and each row falls to the shard in whose equal share of all
bytes its middle byte lies. Only ids, sizes and checksums are moved, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import part_offsets, ranked_in_ranges, text_or_empty


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut ``docs``, in ascending id, into ``n_shards`` runs of near-equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1 (a null text: 1). Returns the id,
    ``size``, ``text_crc32``, ``shard`` (from 0) and ``slot`` (place in the shard, gapless from 0).
    A shard departs from the mean by at most the size of one row at either end.

    Null ids sort first; rows that share an id stand next to each other, ordered by size and
    checksum; repeated rows each get a slot; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text_or_empty(text_col)).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
    )
    ranked = ranked_in_ranges(rows, "_id", "size", "text_crc32")
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.join(F.broadcast(part_offsets(ranked, "size")), "part").select(  # a row for each partition
        "_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.col("at")).alias("_rank"),
        (F.col("total_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("_start"),
        "total",
    )
    middle = (F.col("_start") * 2 + F.col("size")).cast("decimal(38,0)") * n_shards
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle / (F.col("total") * 2)).cast("int"))).drop("total", "_start")
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")
    )
