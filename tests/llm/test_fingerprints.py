import hashlib
import random
import re

from pyspark.sql import types as T

from examlake.llm import fingerprints as fp

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("cell", T.StringType())])


def paragraphs(text):
    return {m[0] for m in re.finditer(fp.PARAGRAPH, text)}


def likeness(a, b):
    x, y = paragraphs(a), paragraphs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choices("abcdeé", k=4)) for _ in range(rng.randint(2, 40)))
    shared = [sentence() for _ in range(20)]
    texts = ["", None, "x", "no end " * 60, "é\U0001f600\n\n.", ". ".join(sentence() for _ in range(900))]
    texts += [". ".join([*rng.sample(shared, 8), sentence()]) + ".\n" for _ in range(30)]
    texts += [texts[-1]]
    rows = [(None, "of no id. at all.")] + [(3 * i + 1, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame([(i, t, "k", None) for i, t in rows], DOCS).repartition(3)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        text, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert abs(row.near_edited - likeness(text, edited)) < 1e-9, i
        assert abs(row.near_next - likeness(text, following)) < 1e-9, i
    assert got[3 * len(texts) - 2].fingerprint == got[3 * len(texts) - 5].fingerprint


def test_repeats_one_row_and_nothing(spark):
    rows = [(1, "a. b. c. d."), (1, "a. b. c. d."), (1, "other."), (2, "a. b. c.")]
    got = fp.fingerprints(spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]
    assert len({(r.fingerprint, r.near_next) for r in got if r.n_chars == 11}) == 1
    lone = fp.fingerprints(spark.createDataFrame([(7, "a. b.", None, None)], DOCS)).first()
    assert lone.near_next == 1.0
    assert fp.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_peeling_recovers_digests_and_retries(spark):
    rng = random.Random(2)
    draw = lambda n: [rng.randrange(-(2**31), 2**31) for _ in range(n)]
    both = draw(500)
    pairs = [(0, both, both), (1, [*both, *draw(3)], [*both, *draw(2)]), (2, draw(700), draw(600)), (3, [], draw(5)), (4, [], [])]
    rows = {r.k: r for r in fp.differing_digests(spark.createDataFrame(pairs, "k int, plus array<int>, minus array<int>"), ["k"]).collect()}
    for k, plus, minus in pairs:
        assert rows[k].only_plus == sorted(set(plus) - set(minus)) and rows[k].only_minus == sorted(set(minus) - set(plus))
    assert rows[1].attempt == 0 and 0 < rows[2].attempt < 4
