import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from examlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=20):
    """Every document scored for every item, by the rules as they stand."""
    words = [(d, TERM.findall((t or "").translate(FOLD))) for d, t in docs]
    n_docs, length = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for d, w in words:
            if w:
                tf, m = Counter(w), 100 - 25 + (25 * len(w) * n_docs) // length
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in TERM.findall((text or "").translate(FOLD)) if tf[t])
                if score > 0:
                    scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def made(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Éa", "X-y", "日本", "A1", "it's"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[5][1]) for i in range(40)] + [(None, docs[5][1]), (None, None), (7, docs[7][1]), (n_docs + 50, ""), (n_docs + 51, " -- ")]
    return docs, [(i, text(rng.randint(1, 12))) for i in range(n_items)] + [(-1, docs[5][1]), (-2, None), (-3, "nowhere"), (-4, "w1 w1 w1 w2")]


@pytest.mark.parametrize("shard, block", [(4096, 2000), (16, 5), (1, 1)])
def test_ranks_equal_plain_scores(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    docs, items = made(1, 260, 9 if block < 2000 else 30)
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, score string").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical.ranked(d, i, shard_docs=shard).select("item_id", "rank", "doc_id", "score").collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(plain(docs, items), key=key)


def test_bounds_hold_and_pairs_are_tighter():
    rng = np.random.default_rng(3)
    tighter = 0
    for _ in range(40):
        n, n_terms = 60, 12
        held = [np.sort(rng.choice(n_terms, rng.integers(1, n_terms), replace=False)) for _ in range(n)]
        of_doc, terms = np.repeat(np.arange(n), [len(h) for h in held]), np.concatenate(held)
        weight = rng.integers(1, 5000, n_terms)
        shard = lexical.Shard(rng.integers(5, 90, n), of_doc, terms, rng.integers(1, 9, len(terms)), weight, n, 50 * n)
        times = {t: int(rng.integers(1, 4)) for t in rng.choice(n_terms, 7, replace=False).tolist()}
        groups = lexical.chosen_pairs(times, weight)
        shard.add_pairs([g for g in groups if len(g) == 2])
        whole = np.zeros(n, np.int64)
        for g in groups:
            part = np.zeros(n, np.int64)
            for t in g:
                if t in shard.lists:
                    part[shard.lists[t][0]] += times[t] * shard.lists[t][1]
            assert part.max() <= shard.bound(g, times)
            tighter += shard.bound(g, times) < sum(times[t] * shard.most.get(t, 0) for t in g)
            whole += part
        for least in (1, int(np.median(whole)), int(whole.max()), int(whole.max()) + 1):
            docs, scores = shard.search(groups, times, least)
            assert dict(zip(docs.tolist(), scores.tolist(), strict=True)) == {d: s for d, s in enumerate(whole.tolist()) if s >= least}
    assert tighter > 20


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.where("false"), items).count() == 0
    assert lexical.ranked(docs, items.where("false")).count() == 0
    assert lexical.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_string_ids_and_long_text(spark):
    docs = spark.createDataFrame([("a", "x " * 200_000 + "rare"), ("b", "x y")], "name string, body string")
    items = spark.createDataFrame([("q", "rare y")], "name string, body string")
    got = lexical.ranked(docs, items.withColumnRenamed("name", "item"), doc_id="name", item_id="item", doc_text="body", item_text="body").collect()
    assert [(r["item"], r["rank"], r["name"]) for r in sorted(got, key=lambda r: r["rank"])] == [("q", 1, "b"), ("q", 2, "a")]
