import random

import numpy as np
from pyspark.sql import types as T

from examlake.llm import near_dedup
from examlake.llm.graph import components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("bands", T.StringType()), T.StructField("family", T.StringType())])


def shingles(text, n=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):  # families: copies and chains of edits
        words = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            if rng.random() < 0.7:
                words = list(words)
                for _ in range(rng.choice([0, 1, 1, 2])):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += [None, "", " \n", "one", "ONE", "one two", "É", "é", "x " * 5000, "x " * 5001]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(spark, monkeypatch):
    for seed, block in ((1, 1024), (2, 7)):
        monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
        rows = corpus(seed)
        got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, "b", None) for i, t in rows], DOCS).repartition(3)).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_repeats_nulls_and_nothing(spark):
    text = "a b c d e f g"
    rows = [(5, text, "", ""), (5, text, "", ""), (None, text, "", ""), (9, text, "", ""), (2, None, None, None)]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == sorted([(5, 4, 5, True), (5, 4, 5, True), (None, 4, None, True), (9, 4, 5, False), (2, 0, 2, True)], key=repr)
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_beyond_doubles_beside_a_null(spark):
    big, text = 2**60, "a b c d e f g"
    rows = [(big + 1, text, "", ""), (None, text, "", ""), (big + 3, text, "", ""), (big + 2, "x y", "", "")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()}
    assert got == {big + 1: big + 1, big + 3: big + 1, big + 2: big + 2, None: None}


def test_no_link_of_a_large_family_is_lost():
    """A family of 1,500 near-copies by edits: the signatures' pre-filter leaves all joined that exact likeness joins."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = []
    for _ in range(1500):  # at 0.80 to 0.9 of each other, many right at the limit
        s = base.copy()
        s[rng.choice(len(s), rng.integers(5, 23), replace=False)] = rng.integers(0, 2**63, 1).astype(np.uint64)[0] + np.arange(0, 1, dtype=np.uint64)
        sets.append(np.unique(s))
    links = near_dedup._forest(np.arange(len(sets)), sets, None, 80)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    mine = [find(i) for i in range(len(sets))]
    exact = 0
    for i in range(0, len(sets), 25):
        for j in range(i):
            if near_dedup._linked(sets[i], sets[j], 80):
                exact += 1
                assert mine[i] == mine[j]
    assert exact > 1000


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for shared in (900, 500):
        a, b = base, np.concatenate((base[:shared], rng.integers(0, 2**63, 1000 - shared).astype(np.uint64)))
        share = (near_dedup.signature(np.sort(a)) == near_dedup.signature(np.sort(b))).mean()
        assert abs(share - shared / (2000 - shared)) < 0.12


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (2000, 1999)], "a long, b long")
    for last in (0, 20, 1000):  # rounds alone, rounds and a last task, the task alone
        got = {r.node: r.component for r in components(links, last).collect()}
        assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
