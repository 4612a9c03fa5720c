"""Byte-level byte-pair encoding by a global shuffle of distinct words.

Texts are split into words (matches of the splitting pattern) block by block; a block keeps its
distinct words, numbered, and the positions of each text as numbers. The words of all blocks meet by
hash, bucket by bucket, so each distinct word is encoded once, its ids are looked up in the table of
token bytes, and both are joined back to the blocks that hold the word. Each text is then put together
again by position. A word of all blocks (a blank, "the") travels once for each block, never for each
place, and a block's words of one bucket are one compressed row. The positions lie bucketed by block,
so they don't travel at all.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_partitions, text_or_empty, use_checkpoint_dir

#: A block ends with the text that brings it to so many characters. Bounds memory, never results.
BLOCK_CHARS = 24_000_000
#: Bytes that the words of a bucket may take in a worker, about; what is beyond is encoded again when it comes again.
BUCKET_BYTES = 128_000_000
#: Words of more bytes than this are merged through a heap.
LONG_WORD = 256
#: Longer texts are split into words in stretches of about this length, so that no list holds all words of one text.
STRETCH = 1_000_000
#: Buckets of words for each shuffle partition.
BUCKETS_EACH = 8

# The white space of the pattern.
_SPACE = r"\t-\r \x85\xa0  -     　"


def _pattern(letters: str, numbers: str) -> re.Pattern:
    """The splitting pattern over explicit classes, which the standard library's engine matches fastest."""
    # The forms that the public pattern names, in its order.
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _as_class(chars: list[int]) -> str:
    """The members of a character class, as ranges."""
    points = np.array(chars)
    starts = np.flatnonzero(np.diff(points, prepend=-2) > 1)
    ends = np.append(starts[1:], len(points)) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[starts], points[ends], strict=True))


class Splitter:
    """Splits as tiktoken does with ``pattern``; its tables of letters and numbers are older than those of ``regex``."""

    def __init__(self) -> None:
        self.ascii = _pattern("A-Za-z", "0-9")
        self.wide: dict[int, re.Pattern] = {}

    def _wide(self, end: int) -> re.Pattern:
        import regex

        if end not in self.wide:
            points = "".join(map(chr, (c for c in range(end) if not 0xD800 <= c < 0xE000)))
            newer = _newer_than_library()
            found = [[ord(c) for c in regex.findall(rf"\p{{{kind}}}", points) if c not in newer] for kind in "LN"]
            self.wide[end] = _pattern(*map(_as_class, found))
        return self.wide[end]

    def words(self, text: str) -> Iterator[list[str]]:
        """Lists of the words of ``text``, in order. Cuts between them are made before white space, where a word always ends."""
        if text.isascii():
            found = self.ascii
        else:  # beyond the basic plane a pattern of its own, as such classes are slow to search
            found = self._wide(0x10000 if 2 * len(text) == len(text.encode("utf-16-le")) else 0x110000)
        at = 0
        while len(text) - at > STRETCH:
            cut = _WORD_END.search(text, at + STRETCH)
            if cut is None:
                break
            yield found.findall(text[at : cut.end()])
            at = cut.end()
        yield found.findall(text[at:] if at else text)


_WORD_END = re.compile(rf"[^{_SPACE}](?=[{_SPACE}])")


@lru_cache(maxsize=1)
def _newer_than_library() -> set[str]:
    """Letters and numbers that ``regex`` knows and the library's older tables don't: it treats them as symbols.

    Told by the library itself, which merges a symbol and the first byte of such a character.
    """
    import public_tokenizers
    import regex
    import tiktoken

    doubtful = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"]
    doubtful = regex.findall(r"[\p{L}\p{N}]", "".join(doubtful))
    firsts = sorted({c.encode()[0] for c in doubtful})
    ranks = {bytes([b]): b for b in range(256)} | {b"!" + bytes([b]): 256 + k for k, b in enumerate(firsts)}
    library = tiktoken.Encoding("symbols", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {c for c in doubtful if library.encode_ordinary("!" + c)[0] >= 256}


class WordEncoder:
    """Merges the bytes of a word by rank, least rank first and leftmost among equals."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}

    def ids(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        bounds = self._merged(word) if len(word) <= LONG_WORD else self._merged_long(word)
        return [self.ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merged(self, word: bytes) -> list[int]:
        rank, none = self.ranks.get, len(self.ranks) + 1_000_000
        bounds = list(range(len(word) + 1))
        pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            del pairs[i], bounds[i + 1]
            if i < len(pairs):
                pairs[i] = rank(word[bounds[i] : bounds[i + 2]], none)
            if i:
                pairs[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], none)
        return bounds

    def _merged_long(self, word: bytes) -> list[int]:
        """The same, in time that grows with n log n: pairs wait in a heap, those that a merge has changed are passed over."""
        n, rank = len(word), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := rank(word[i : (end := after[after[i]])])) is not None:
                heapq.heappush(heap, (r, i, end))

        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            alive[after[i]] = 0
            after[i] = end
            if end < n:
                before[end] = i
            offer(i)
            offer(before[i])
        return [i for i in range(n) if alive[i]] + [n]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each rank file and worker process."""
    return WordEncoder(path)


@lru_cache(maxsize=1)
def splitter() -> Splitter:
    return Splitter()


_ZSTD = pa.Codec("zstd")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed: four runs of bytes, the lowest first, as the higher ones are nearly all zero."""
    return _ZSTD.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(raw, 4 * n), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, block_chars: int) -> Iterator[pa.RecordBatch]:
    """For each block a row of its texts (how many words each has, and all positions) and rows of its distinct words, a bucket each."""
    from pyspark import TaskContext

    part, words_of = TaskContext.get().partitionId(), splitter().words
    keys, sizes, places, numbered, chars, block = [], [], [], _Numbered(), 0, part << 32
    key_type = None

    def flushed() -> Iterator[pa.RecordBatch]:
        at = np.concatenate(places) if places else np.zeros(0, np.uint32)
        yield _rows(key_type, block, 1, keys=pa.array([keys], pa.list_(key_type)), sizes=pa.array([sizes], pa.list_(pa.int64())), places=pa.array([_packed(at)], pa.binary()))
        words = [w.encode() for w in numbered]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        held = np.split(order, starts[1:]) if len(order) else []
        joined = [[words[i] for i in some] for some in held]
        if held:
            yield _rows(
                key_type, block, len(used), bucket=pa.array(used), n=pa.array([len(x) for x in held], pa.int32()), numbers=pa.array([_packed(x) for x in held], pa.binary()),
                lengths=pa.array([_packed(np.fromiter(map(len, x), np.int64, len(x))) for x in joined], pa.binary()), words=pa.array([_ZSTD.compress(b"".join(x), asbytes=True) for x in joined], pa.binary()),
            )

    for batch in batches:
        key_type = batch.schema.field(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = [np.fromiter(map(numbered.__getitem__, words), np.uint32, len(words)) for words in words_of(text)]
            keys.append(key)
            sizes.append(sum(map(len, found)))
            places += found
            chars += len(text)
            if chars >= block_chars:
                yield from flushed()
                keys, sizes, places, numbered, chars, block = [], [], [], _Numbered(), 0, block + 1
    if keys:
        yield from flushed()


def _rows(key_type: pa.DataType, block: int, count: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"keys": pa.list_(key_type), "sizes": pa.list_(pa.int64()), "places": pa.binary(), "bucket": pa.int32(), "n": pa.int32(), "numbers": pa.binary(), "lengths": pa.binary(), "words": pa.binary()}
    return pa.RecordBatch.from_pydict({"block": pa.array(np.full(count, block))} | {c: columns.get(c, pa.nulls(count, t)) for c, t in kinds.items()})


def _bucketed(df: DataFrame, buckets: int, by: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: one state for all readers, a cut of the lineage, and rows that lie together by ``by``.

    The table's name is given up at once; its files stay, and the result reads those.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    name = f"words_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    df.write.bucketBy(buckets, by).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _coded(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Ids and bytes of each block's words. Rows come bucket by bucket, so what a bucket has seen is enough to encode each distinct word once."""
    coder, bucket, seen, room = encoder(ranks_path), None, {}, BUCKET_BYTES
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            if row["bucket"] != bucket:
                bucket, seen, room = row["bucket"], {}, BUCKET_BYTES
            ends = np.cumsum(_unpacked(row["lengths"], row["n"]), dtype=np.int64).tolist()
            words, start, ids, raw = _ZSTD.decompress(row["words"], ends[-1], asbytes=True), 0, [], []
            for end in ends:
                word = words[start:end]
                start = end
                found = seen.get(word)
                if found is None:
                    tokens = coder.ids(word)
                    found = np.array(tokens, "<u4").tobytes(), b"".join([coder.tokens[i] for i in tokens])
                    room -= 250 + 2 * len(word) + len(found[0])
                    if room > 0:
                        seen[word] = found
                ids.append(found[0])
                raw.append(found[1])
            yield pa.RecordBatch.from_pylist([{
                "of_block": row["block"], "n": row["n"], "numbers": row["numbers"],
                "id_counts": _packed(np.fromiter(map(len, ids), np.int64, len(ids)) // 4), "ids": _packed(np.frombuffer(b"".join(ids), "<u4")),
                "byte_counts": _packed(np.fromiter(map(len, raw), np.int64, len(raw))), "bytes": _ZSTD.compress(b"".join(raw), asbytes=True),
            }], pa.schema(_CODED))


_CODED = [("of_block", pa.int64()), ("n", pa.int32()), ("numbers", pa.binary()), ("id_counts", pa.binary()), ("ids", pa.binary()), ("byte_counts", pa.binary()), ("bytes", pa.binary())]


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The vocabulary as a table: ``id``, ``bytes``. As large as the rank file, whatever the corpus."""
    tokens = read_ranks(ranks_path)
    return spark.createDataFrame(pd.DataFrame({"id": list(tokens.values()), "bytes": list(tokens)}), "id int, bytes binary")


def decoded(ids: DataFrame, tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the bytes of the token ids in ``ids_col`` (array of int; null or empty: no bytes).

    Ids are exploded with their positions, joined with the token table (broadcast: a vocabulary) and put
    together by position, row by row. An id without a token gives no bytes. Rows that repeat stay apart.
    """
    row = "_row"
    while row in ids.columns:
        row += "_"
    marked = ids.withColumn(row, F.struct(F.monotonically_increasing_id().alias("id")))
    named = tokens.select(F.col("id").alias("_id"), F.col("bytes").alias("_bytes"))
    pieces = marked.select("*", F.posexplode_outer(ids_col).alias("_at", "_id")).join(F.broadcast(named), "_id", "left")
    kept = [F.first(c).alias(c) for c in ids.columns]
    together = F.array_sort(F.collect_list(F.struct("_at", "_bytes")))
    whole = F.aggregate(together, F.lit(b""), lambda s, p: F.concat(s, F.coalesce(p["_bytes"], F.lit(b""))))
    return pieces.groupBy(row).agg(*kept, whole.alias(out_col)).drop(row)


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` of each whole text.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers (``id_list`` makes an array of
    them), ``decoded`` the bytes that they stand for. Special tokens are ordinary text. A null or empty
    text has no ids. Each row is encoded by itself, so null or repeated ids, ties and repeated rows change
    nothing; an empty table gives an empty result, and other columns are not looked at.
    """
    n = n_partitions(docs.sparkSession)
    key = docs.schema[id_col].dataType
    parts = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(key)), *T.StructType.fromDDL("sizes array<long>, places binary, bucket int, n int, numbers binary, lengths binary, words binary")])
    texts = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    split = _bucketed(texts.mapInArrow(lambda batches: _blocks(batches, BUCKETS_EACH * n, block_chars), parts), n, "block")

    # A word's bucket follows from the word, so equal words meet where their bucket lies.
    dealt = split.where("bucket is not null").select("block", "bucket", "n", "numbers", "lengths", "words").repartition(n, "bucket").sortWithinPartitions("bucket")
    coded = dealt.mapInArrow(lambda batches: _coded(batches, ranks_path), "of_block long, n int, numbers binary, id_counts binary, ids binary, byte_counts binary, bytes binary")

    # Positions stay where they were written; only the coded words of a block are moved to them.
    positions = split.where("places is not null").select("block", "keys", "sizes", "places")
    out = T.StructType([T.StructField("key", key), *T.StructType.fromDDL("ids binary, decoded binary")])
    return positions.groupBy("block").cogroup(coded.groupBy("of_block")).applyInArrow(_put_together, out).withColumnRenamed("key", id_col)


def _put_together(texts: pa.Table, words: pa.Table) -> pa.Table:
    """Ids and bytes of a block's texts, from positions and the coded words."""
    numbers, counts, values = [], ([], []), ([], [])
    for row in words.to_pylist():
        numbers.append(_unpacked(row["numbers"], row["n"]))
        id_counts, byte_counts = (_unpacked(row[c], row["n"]).astype(np.int64) for c in ("id_counts", "byte_counts"))
        counts[0].append(id_counts)
        counts[1].append(byte_counts)
        values[0].append(_unpacked(row["ids"], int(id_counts.sum())))
        values[1].append(np.frombuffer(_ZSTD.decompress(row["bytes"], int(byte_counts.sum())), np.uint8))
    lists = [_by_number(np.concatenate(v), np.concatenate(c), np.concatenate(numbers)) for v, c in zip(values, counts, strict=True)] if numbers else []
    keys, found = [], ([], [])
    for row in texts.to_pylist():  # one
        keys += row["keys"]
        ends = np.cumsum(row["sizes"])
        places = _unpacked(row["places"], int(ends[-1]))
        for lo, hi in zip(ends - row["sizes"], ends, strict=True):
            at = places[lo:hi]
            for k, out in enumerate(found):
                if not len(at):
                    out.append(b"")
                    continue
                every, start, size = lists[k]
                n = size[at]
                after = np.cumsum(n)
                out.append(every[np.repeat(start[at] - (after - n), n) + np.arange(after[-1])].tobytes())
    key_type = texts.schema.field("keys").type.value_type
    return pa.table({"key": pa.array(keys, key_type), "ids": pa.array(found[0], pa.binary()), "decoded": pa.array(found[1], pa.binary())})


def _by_number(values: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``values`` and, by a word's number, where its own begin and how many they are."""
    start, size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    start[numbers], size[numbers] = np.cumsum(counts) - counts, counts
    return values, start, size


def id_list(ids: str = "ids"):
    """Column expression: the packed ids as an array of int."""

    @F.pandas_udf("array<int>")
    def listed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda raw: None if raw is None else np.frombuffer(raw, "<u4").astype(np.int32))

    return listed(F.col(ids))
