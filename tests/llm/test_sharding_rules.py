import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from examlake.llm import quality_rules
from examlake.llm.quality_rules import apply_rules
from examlake.llm.sharding import shard_by_bytes

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("size", T.StringType()), T.StructField("part", T.StringType())])


def brute_shards(rows, n):
    sized = sorted([(-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows])
    total, start, slots, out = sum(s for _, s, _ in sized), 0, {}, []
    for i, s, c in sized:
        shard = min(n - 1, (2 * start + s) * n // (2 * total))
        out.append((i, s, c, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        start += s
    return out


def test_shards_match_brute_force(spark):
    rows = [(i, "é" * (i * 37 % 101) if i % 7 else None) for i in range(200)] + [(None, "x"), (3, "again"), (3, "again"), (500, "y" * 5000)]
    got = shard_by_bytes(spark.createDataFrame([(i, t, "a", None) for i, t in rows], DOCS), 8).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(brute_shards(rows, 8))


def test_shards_of_nothing_and_of_one(spark):
    assert shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0
    assert [(r.shard, r.slot) for r in shard_by_bytes(spark.createDataFrame([(1, None, None, None)], DOCS)).collect()] == [(4, 0)]


def brute_repeat(words):
    wins, cover = [tuple(words[i : i + 5]) for i in range(len(words) - 4)], set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            cover |= set(range(i, i + 5))
    return len(cover)


def test_rules_counts_and_edges(spark):
    texts = {
        1: None,
        2: "",
        3: "the cat sat on the mat and it was the end of the day for all of us",
        4: "a b c d e " * 8,
        5: "one two three four five six one two three four five seven two three four five six",
        6: "x # y $ z\nline\nline\n \nline",
        7: "  \u0085 éé \U0001f600\x0bq",
    }
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("quality", T.IntegerType()), T.StructField("_words", T.StringType())])
    got = {r.doc_id: r for r in apply_rules(spark.createDataFrame([(i, t, "k", 1, None) for i, t in texts.items()], schema)).collect()}
    assert len(got) == len(texts)
    import re

    for i, t in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        q = got[i].quality
        assert q.n_words == len(words) and q.word_chars == sum(map(len, words)), i
        assert q.n_repeat_words == brute_repeat(words), i
        assert q.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        lines = [s for s in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        assert q.n_dup_lines == len(lines) - len(set(lines))
        assert got[i].base_failed == (len(words) < 10 or 100 * q.n_repeat_words > 20 * len(words))
    assert got[3].kept and not got[1].kept and not got[4].kept
    assert apply_rules(spark.createDataFrame([], schema)).count() == 0


def test_rules_keep_columns_of_inner_names(spark):
    docs = spark.createDataFrame([(1, "word " * 30, "a"), (1, "word " * 30, "a"), (2, "some words stand in this long enough text of ten and more " * 4000, "b")], "doc_id long, text string, x string").select("*", F.col("x").alias("_q_symbol_ratio"), F.col("x").alias("_words"))
    got = quality_rules.apply_rules(docs).collect()
    assert [(r.x, r._q_symbol_ratio, r._words) for r in got] == [("a",) * 3, ("a",) * 3, ("b",) * 3]
    assert got[0] == got[1] and got[2].quality.n_words == 12 * 4000 and got[2].quality.n_repeat_words == 12 * 4000
