import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from examlake.llm import prefix_trie
from examlake.llm.queries import op12_burst_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string"


def plain(rows, shared_of):
    """Every prefix of every rebuilt conversation, looked up in a dictionary."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    built = dict(own)
    if shared_of:
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = own.get(c - int(math.fmod(c, shared_of)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        words = len("".join(x if x in " \t\n\v\f\r" else "w" for x in p[-1][1]).split()) if p else 0
        leaves = sum(out[k][5] for k in below) or 1
        saved = sum(out[k][6] for k in below) + (len(members[p]) - 1) * words
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def nodes(spark, rows, shared_of, limit, deal=3):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(deal)
    got = prefix_trie.trie_nodes(prefix_trie.conversations(turns, shared_of), limit)
    assert got.columns == list(prefix_trie.NODE_COLUMNS)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[1], r[0]))


def made(seed, n):
    """Conversations over few texts, so that long prefixes are shared; some equal, some without turns of their own."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        talk = [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "x\x0by z"])) for _ in range(rng.randint(1, 6))]
        if c % 5 == 0:
            talk = [("user", "hello there"), ("assistant", "hi")] * 3
        rows += [(c * 3 - 30, None if rng.random() < 0.05 else t, r, x, "clash") for t, (r, x) in enumerate(talk)]
    return [*rows, (None, 0, "user", "lost", ""), rows[4], (9_999, 5, "user", "t" * 300_000, ""), (16_384 * 7, 0, "user", "a b", "")]


@pytest.mark.parametrize("limit", [2, 20, 4096])
def test_nodes_equal_plain_prefixes(spark, limit):
    rows = made(2, 70)
    assert nodes(spark, rows, 20, limit) == plain(rows, 20)


def test_without_shared_beginnings(spark):
    rows = made(3, 40)
    assert nodes(spark, rows, 0, 2) == plain(rows, 0)


def test_long_chain_and_comb(spark):
    """A beginning of 90 turns that many share, and conversations that leave it one by one."""
    rows = [(c, t, "user", f"say {t}", "") for c in range(5) for t in range(90)]
    rows += [(100 + c, t, "user", f"say {t}" if t < c else "leave", "") for c in range(7) for t in range(c + 1)]
    assert nodes(spark, rows, 0, 3) == plain(rows, 0)


def test_many_equal_conversations_over_ranges_of_ids(spark):
    rows = [(c * 5000, 0, "user", "same", "") for c in range(60)] + [(7, 0, "user", "other", "")]
    assert nodes(spark, rows, 0, 1) == plain(rows, 0)


def test_empty_tables(spark):
    assert nodes(spark, [], 20, 4) == []
    assert nodes(spark, [(None, 1, "user", "x", "")], 20, 4) == []
    short = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)  # its only turn is cut, and no conversation 0 is there
    assert nodes(spark, [(short, 0, "user", "x", "")], 20, 4) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text", F.lit("")).collect()]
    assert sorted((tuple(r) for r in op12_burst_trie(spark, d).collect()), key=lambda r: (r[1], r[0])) == plain(rows, 20)
