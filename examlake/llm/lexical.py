"""Ranked lexical search with pair bounds.

Documents are dealt to shards. A shard's index holds, for each term of the query set, the documents
and the impacts (exact integer scores of one occurrence in the query) with their maximum, and for
pairs of terms that queries name together the intersection list with its joint maximum. A query adds
up the bounds of its pairs, which are tighter than sums of single maxima: groups whose bounds together
stay below the score of the twentieth document so far cannot bring in a new document, and a candidate
is dropped as soon as what is left cannot lift it. Nothing is lost, as a document is passed over only
when its bound is strictly below that score.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import text_or_empty, use_checkpoint_dir

#: Documents in a shard, and terms of documents that end one early. Bound memory, never results.
SHARD_DOCS, SHARD_POSTINGS = 4096, 2_000_000
#: Items of a block of queries, and distinct terms that end one early; a block's terms go to every task.
BLOCK_ITEMS, BLOCK_TERMS = 2000, 200_000

#: A-Z to a-z and separators to blanks, byte by byte; bytes beyond ASCII stay.
_FOLDED = bytes(b | 0x20 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b >= 0x80 or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return text.encode().translate(_FOLDED).split()


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, dict[bytes, int]]]:
    """Blocks of queries: ([(item, {term number: occurrences})], {term: number})."""
    queries, numbers = [], {}
    for key, text in items.select(id_col, text_or_empty(text_col)).toLocalIterator():
        counted = Counter(terms_of(text))
        queries.append((key, {numbers.setdefault(t, len(numbers)): n for t, n in counted.items()}))
        if len(queries) >= BLOCK_ITEMS or len(numbers) >= BLOCK_TERMS:
            yield queries, numbers
            queries, numbers = [], {}
    if queries:
        yield queries, numbers


def term_counts(docs: DataFrame, numbers: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """A row for each document with a term: ``key``, ``n`` (terms with repeats), ``terms``, ``tfs`` (of the numbered terms)."""
    key = T.StructField("key", docs.schema[id_col].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # at most BLOCK_TERMS, or one item's

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            keep, sizes, terms, tfs = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    of_queries = Counter(filter(None.__ne__, map(number, found)))
                    keep.append(row)
                    sizes.append(len(found))
                    terms.append(np.fromiter(of_queries.keys(), np.int32, len(of_queries)))
                    tfs.append(np.fromiter(of_queries.values(), np.int64, len(of_queries)))
            yield pa.RecordBatch.from_pydict({"key": batch.column(0).take(pa.array(keep, pa.int64())), "n": pa.array(sizes, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    out = T.StructType([key, *T.StructType.fromDDL("n long, terms array<int>, tfs array<long>")])
    return docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text")).mapInArrow(counted, out)


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/terms-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def weights(counts: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each numbered term over all documents, the number of documents and of all their terms."""
    n_docs, length = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most n_terms rows
        df[row[0]] = row[1]
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64), n_docs, length


def chosen_pairs(terms: dict[int, int], weight: np.ndarray) -> list[tuple[int, ...]]:
    """The groups of a query: its terms in ascending weight, two by two, the lightest together."""
    by_weight = sorted(terms, key=lambda t: (weight[t], t))
    return [tuple(sorted(by_weight[i : i + 2])) for i in range(0, len(by_weight), 2)]


class Shard:
    """The index of a shard: postings of single terms and intersection lists of pairs, with their greatest impacts."""

    def __init__(self, sizes: np.ndarray, of_doc: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray, n_docs: int, length: int) -> None:
        self.n = len(sizes)
        m = 75 + (25 * sizes * n_docs) // length
        impacts = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[of_doc]))
        order = np.argsort(terms, kind="stable")
        known, starts = np.unique(terms[order], return_index=True)
        ends = np.append(starts, len(order))[1:]
        self.lists = {int(t): (of_doc[order[a:b]], impacts[order[a:b]]) for t, a, b in zip(known, starts, ends, strict=True)}
        self.most = {t: int(i.max()) for t, (_, i) in self.lists.items()}
        self.joint: dict[tuple[int, int], tuple[np.ndarray, int]] = {}

    def add_pairs(self, pairs) -> None:
        """Intersection list and greatest joint impact of each pair; pairs that no document has are kept as such."""
        dense: dict[int, np.ndarray] = {}
        for a, b in pairs:
            if a in self.lists and b in self.lists:
                if len(self.lists[a][0]) > len(self.lists[b][0]):
                    a, b = b, a
                if b not in dense:
                    dense[b] = np.zeros(self.n, np.int64)
                    dense[b][self.lists[b][0]] = self.lists[b][1]
                docs, impacts = self.lists[a]
                other = dense[b][docs]
                both = other > 0
                self.joint[min(a, b), max(a, b)] = (docs[both], int((impacts[both] + other[both]).max(initial=0)))

    def bound(self, group: tuple[int, ...], times: dict[int, int]) -> int:
        """No document has more from ``group``."""
        alone = [times[t] * self.most.get(t, 0) for t in group]
        if len(group) == 1 or group not in self.joint:
            return sum(alone)
        both = max(times[t] for t in group) * self.joint[group][1]
        return min(sum(alone), max(*alone, both))

    def search(self, groups: list[tuple[int, ...]], times: dict[int, int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with scores of ``least`` or more (all of them), and the scores."""
        bounds = sorted((self.bound(g, times), g) for g in groups)
        below = np.cumsum([b for b, _ in bounds])
        first = int(np.searchsorted(below, least))  # groups before it cannot reach ``least`` together
        if first == len(bounds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(self.n, np.int64)
        for _, group in bounds[first:]:
            self._add(score, group, times, None)
        alive = score > 0
        for at in range(first - 1, -1, -1):
            alive &= score + below[at] >= least
            if not alive.any():
                break
            self._add(score, bounds[at][1], times, alive)
        found = np.flatnonzero(alive & (score >= least))
        return found, score[found]

    def _add(self, score: np.ndarray, group: tuple[int, ...], times: dict[int, int], alive: np.ndarray | None) -> None:
        for t in group:
            if t in self.lists:
                docs, impacts = self.lists[t]
                if alive is not None:
                    held = alive[docs]
                    docs, impacts = docs[held], impacts[held]
                score[docs] += times[t] * impacts


def _shards(batches: Iterator[pa.RecordBatch], shard_docs: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, sizes, and the place, term and frequency of each posting, a shard at a time."""
    for batch in batches:
        held = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        before = np.cumsum(held) - held
        cuts = np.flatnonzero(np.diff(np.maximum(before // SHARD_POSTINGS, np.arange(len(held)) // shard_docs), prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(held)], strict=True):
            rows = batch.slice(a, b - a)
            yield rows.column("key"), rows.column("n").to_numpy(), np.repeat(np.arange(b - a), held[a:b]), rows.column("terms").flatten().to_numpy().astype(np.int64), rows.column("tfs").flatten().to_numpy()


def _ranked_block(counts: DataFrame, queries: list, n_terms: int, k: int, item: T.DataType, shard_docs: int) -> DataFrame:
    weight, n_docs, length = weights(counts, n_terms)
    grouped = [(times, chosen_pairs(times, weight)) for _, times in queries]
    pairs = sorted({g for _, groups in grouped for g in groups if len(g) == 2})
    shared = counts.sparkSession.sparkContext.broadcast((grouped, pairs, weight))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped, pairs, weight = shared.value
        tops: list[list[tuple]] = [[] for _ in grouped]  # (-score, whether null, document): in the order of ranks
        for keys, sizes, of_doc, terms, tfs in _shards(batches, shard_docs):
            shard = Shard(sizes, of_doc, terms, tfs, weight, n_docs, length)
            shard.add_pairs(pairs)
            for q, (times, groups) in enumerate(grouped):
                top = tops[q]
                found, scores = shard.search(groups, times, -top[-1][0] if len(top) == k else 1)
                if len(found) > k:  # those that tie with the last stay
                    held = scores >= np.partition(scores, -k)[-k]
                    found, scores = found[held], scores[held]
                if len(found):
                    new = [(-s, d is None, d) for s, d in zip(scores.tolist(), keys.take(pa.array(found)).to_pylist(), strict=True)]
                    tops[q] = sorted(top + new, key=lambda x: x[:2] if x[1] else x)[:k]
        for q, top in enumerate(tops):
            if top:
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(top), q, np.int32)), "key": pa.array([d for _, _, d in top], key_type), "score": pa.array([-s for s, _, _ in top], pa.int64())})

    key = counts.schema["key"]
    key_type = to_arrow_type(key.dataType)
    local = counts.mapInArrow(best, T.StructType([T.StructField("q", T.IntegerType()), key, T.StructField("score", T.LongType())]))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    ranked = local.withColumn("rank", rank).where(F.col("rank") <= k)  # the limit reaches each task before the shuffle
    names = counts.sparkSession.createDataFrame([(q, i) for q, (i, _) in enumerate(queries)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", item)]))
    return ranked.join(F.broadcast(names), "q").select("item", "rank", "key", "score")  # a block's items


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text", item_text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The ``k`` highest-scoring documents for each row of ``items``: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Every document is looked at and the result is exact; equal scores stand by ascending ``doc_id`` (null
    last), and only scores above 0 are given. A null or empty text has no terms, so such an item gives no
    rows. Rows that repeat are documents (or items) of their own. Items are taken in blocks of bounded size.
    An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    out = T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    found = None
    for queries, numbers in query_blocks(items, item_id, item_text):
        counts = _written(term_counts(docs, numbers, doc_id, doc_text))
        block = _ranked_block(counts, queries, len(numbers), k, items.schema[item_id].dataType, shard_docs).toDF(*out.names)
        found = block if found is None else found.unionByName(block)
    return spark.createDataFrame([], out) if found is None else found
