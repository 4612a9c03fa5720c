"""MinHash near-deduplication with circulant permutations.

All coordinates of a signature come from two permutations of the 32-bit universe: one scatters
the shingles, the other, circularly shifted by another step for each coordinate, orders them.
Bands of coordinates put documents into buckets; documents that share buckets, directly or
through others, form families, outside which there are no candidates. Families are dealt to
tasks (small ones many to a task, large ones by pairs of blocks), and each link is confirmed on
the full shingle sets. Equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, releasing, text_or_empty
from .graph import components

#: Chance that a pair at 0.8 shares no bucket: (1 - 0.8 ** ROWS) ** BANDS, 5e-6.
BANDS, ROWS = 40, 6
#: Families of more documents or shingles than this are dealt by pairs of blocks; the links are the same either way.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
#: Bound on the difference between a pair's likeness and the share of equal coordinates (over 6 sigma at 240).
SLACK = 0.18

_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, n: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles; a shorter text is one shingle.

    A-Z is lower-cased and words are runs without ASCII white space, as bytes.lower() and
    bytes.split() have it. No words: empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        out = np.uint64(len(words))
        for x in h:
            out = _mix64(np.array([out], np.uint64) + x)[0]
        return np.array([out], np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = _mix64(out) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix64(out))


@lru_cache(maxsize=4)
def _shifts(k: int) -> np.ndarray:
    return (np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """``k`` coordinates: the least place of the scattered shingles under the shifted permutation."""
    scattered = (_mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    shifts = _shifts(k)[:, None]
    for start in range(0, len(scattered), 256):
        x = scattered[None, start : start + 256] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    by_band = sig.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(by_band.shape[1]):
        out = _mix64(out) + by_band[:, j]
    return _mix64(out).view(np.int64)


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column("_text"):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128(s.tobytes()).digest())
                bands.append(band_hashes(signature(s)) if len(s) else None)
            # The ids go through untouched: as floats, large ones beside a null would change.
            columns = [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_key", "bands"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["shingles"] = [shingle_set(t, n).tobytes() for t in batch["_text"]]
            yield batch.drop(columns=["_text"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # two sorted runs
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _forest(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join up all that confirmed links join; every pair left apart has been ruled out.

    ``sides``: only pairs from different sides are tried (all pairs where it is None). Likely pairs
    come first, so most others are joined already when their turn comes.
    """
    n = len(ids)
    root = list(range(n))
    links: list[tuple[int, int]] = []
    sigs = np.stack([signature(s).astype(np.uint16) for s in sets]) if n > 8 else None
    sizes = np.array([len(s) for s in sets])
    tries: list[tuple[float, int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def confirm() -> None:
        tries.sort()
        for _, i, j in tries:
            a, b = find(i), find(j)
            if a != b and _linked(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
        tries.clear()

    for i in range(n - 1):
        ok = 100 * np.minimum(sizes[i], sizes[i + 1 :]) >= percent * np.maximum(sizes[i], sizes[i + 1 :])
        if sides is not None:
            ok &= sides[i + 1 :] != sides[i]
        js = np.flatnonzero(ok) + i + 1
        share = np.ones(len(js)) if sigs is None else (sigs[js] == sigs[i]).mean(axis=1)
        near = share >= percent / 100 - SLACK
        tries += [(-s, i, j) for s, j in zip(share[near].tolist(), js[near].tolist(), strict=True)]
        if len(tries) > 200_000:
            confirm()
    confirm()
    return links


def _confirmed(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for _, group in rows.groupby("family", sort=False):
            ids = group["id"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            blocks = group["block"].to_numpy()
            links += _forest(ids, sets, blocks if key[1] != key[2] else None, percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _families(reps: DataFrame) -> DataFrame:
    """``node``, ``family``: joined by shared buckets. Each bucket gives a link to its least member."""
    members = reps.select(F.explode("bands").alias("h"), "rep")
    leaders = members.groupBy("h").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").drop("last")
    return components(members.join(leaders, "h").select(F.col("rep").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("component", "family")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept`` for each row.

    Two documents are linked where 100 * common shingles >= ``percent`` * all their shingles, on
    whole sets. A text without words (null, empty, white space) has no shingles and no links. An id
    stands for one document: rows that repeat an id share its component. A row without an id is kept,
    with a null component. Other columns are ignored; an empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    feats = checkpointed(given.mapInArrow(releasing(_features(shingle_words)), "id long, n_shingles long, set_key binary, bands array<bigint>"))
    classes = feats.where("n_shingles > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    reps = checkpointed(classes)
    families = checkpointed(_families(reps).join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node"))

    by_family = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    by_family = by_family.withColumn("n_blocks", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    totals = by_family.where("n_blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("s")).first()
    n_bins = int(max(1, 2 * totals["n"] // BLOCK_DOCS, 2 * totals["s"] // BLOCK_SHINGLES))
    small = F.col("n_blocks") == 1
    block = F.when(small, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("n_blocks"))).cast("int")
    placed = families.select("node", "family").join(by_family.select("family", "n_blocks"), "family").select(
        F.col("node").alias("_id"), "family", "n_blocks", block.alias("block"), F.when(small, F.pmod(F.xxhash64("family"), F.lit(n_bins))).otherwise(F.col("family")).alias("bin")
    )
    sets = given.join(placed, "_id").mapInPandas(releasing(_sets(shingle_words)), "_id long, family long, n_blocks int, block int, bin long, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    dealt = sets.select(F.col("_id").alias("id"), "family", "block", (F.col("n_blocks") == 1).alias("small"), "bin", "shingles", other)
    dealt = dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other")
    links = dealt.groupBy(F.struct("bin", "small").alias("g"), "x", "y").applyInPandas(_confirmed(percent), "a long, b long")

    joined = components(links)
    of_class = reps.select("set_key", "rep").join(joined, reps["rep"] == joined["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = feats.select("id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
