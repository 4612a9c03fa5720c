import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from examlake.llm import common, rule_ensemble, toxicity
from examlake.llm.queries import op3_quality_ensemble, op7_toxicity_kernel

SF = "/root/testdata/sf0.01"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("quality", T.StringType()), T.StructField("score", T.StringType())])


def auc(labels, scores):
    y, s = np.array(labels), np.array(scores)
    up, down = s[y == 1], s[y == 0]
    return ((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2) if len(up) and len(down) else 1.0


@pytest.fixture(scope="module")
def talk():
    """Clean sentences and ones with insults; every fifth id is not learnt from."""
    rng = random.Random(4)
    syllables = "ba de ki lo mu ra se ti vo nu pe ga".split()
    plain = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(400):
        words = [plain() for _ in range(rng.randint(5, 40))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scumbag", "worthless"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_and_tolerates_gaps(spark, talk):
    docs = spark.createDataFrame([(i, t, "q", "s") for i, t, _ in talk], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in talk], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: float(r.score) for r in toxicity.with_score(docs, model).collect()}
    held = [i for i, _, _ in talk if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc([talk[i][2] for i in held], [got[i] for i in held]) > 0.97
    odd = ["ba de idiot ki", "ba de id-iot ki", "ba i d i o t ki", "ba idxiot ki", "ba de lo ki", "", None, "idiot " * 50_000, "ba idxyiot ki", "ba id-x-iot ki"]
    rows = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(odd)] + [(None, "idiot", "", ""), (0, odd[0], "", "")], DOCS)
    scored = toxicity.with_score(rows, model).collect()
    assert len(scored) == len(odd) + 2 and all(0 <= r.score <= 1 for r in scored)
    by = {r.doc_id: r.score for r in scored}
    assert by[0] == by[1] == by[2] >= by[3] > by[4] and by[5] == by[6] < by[3] and by[7] > 0.5
    assert min(by[8], by[9]) > by[4]  # two characters put in
    assert toxicity.with_score(rows.where("false"), model).count() == 0


def test_no_labels_no_model(spark, talk):
    docs = spark.createDataFrame([(i, t, "q", "s") for i, t, _ in talk[:20]], DOCS)
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.train(docs, none) is None and rule_ensemble.train(docs, none) is None
    assert {r.score for r in toxicity.with_score(docs, None).collect()} == {0.0}
    assert {r.score for r in rule_ensemble.with_score(docs, None).collect()} == {0.5}


def test_labels_that_tell_nothing(spark):
    docs = spark.createDataFrame([(i, t, "q", "s") for i, t in enumerate(["abc", "abc", "abc def ghi", "xyz uvw", "xyz", ""] * 2)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, int(i < 9)) for i in range(12)], "doc_id long, toxic int, quality int")
    assert toxicity.train(docs, labels) is None
    model = rule_ensemble.train(docs.withColumn("text", F.lit("same text")), labels)
    learnt = [int(i < 9) for i in range(12) if zlib.crc32(str(i).encode()) % 5]
    assert model.rules == () and abs(1 / (1 + np.exp(-model.intercept)) - np.mean(learnt)) < 1e-9
    assert {round(r.score, 9) for r in rule_ensemble.with_score(docs, model).collect()} == {round(float(np.mean(learnt)), 9)}


def kernel(word, mark):
    """Plain gap-weighted kernel of a bordered word with a landmark that is open at its end."""

    def subsequences(s):
        found = Counter()
        for n, gaps in toxicity.MAX_GAPS.items():
            for places in combinations(range(len(s)), n):
                inside = places[-1] - places[0] + 1 - n
                if inside <= gaps:
                    found["".join(s[p] for p in places)] += toxicity.GAP**inside
        return found

    a, b = subsequences(f" {word} "), subsequences(f" {mark}")
    return sum(v * b[k] for k, v in a.items() if k in b)


def test_compiled_weights_equal_a_plain_kernel():
    rng = random.Random(2)
    words = ["".join(rng.choices("idotxs", k=rng.randint(1, 9))) for _ in range(60)] + ["idiot", "idxxiot", "ixdxiot", "scum"]
    marks = ["idiot", "scumb", "dot"]
    code = lambda w: (np.array([ord(c) - 96 for c in w], np.uint8) + 48).tobytes().decode("latin1")
    features, matrix, places = toxicity._landmark_features([code(m) for m in marks])
    got = toxicity._kernel_rows([code(w) for w in words], features, matrix, np.eye(len(marks), dtype=np.float32))
    want = np.array([[kernel(w, m) for m in marks] for w in words])
    assert np.abs(got - want).max() < 1e-4
    assert want[words.index("idxxiot"), 0] > want[words.index("scum"), 0]
    # The machine's margin of a word is the weighted sum of its kernel values, by table look-up.
    beta = np.array([0.7, -0.4, 0.2])
    by_place = matrix @ beta
    weights = {n: (np.array([i for m, i in places if m == n]), np.array([v for (m, _), v in zip(places, by_place, strict=True) if m == n], np.float32)) for n in toxicity.PATTERNS}
    model = toxicity.ToxicityModel(weights, -0.3, (1.0, 0.0, 0.0))
    codes, _ = toxicity.codes_of([" ".join(w for w in words if len(w) > 1)])
    _, margins = toxicity.word_margins(codes, model.tables(), model.bias)
    assert np.abs(margins - (want[[len(w) > 1 for w in words]] @ beta - 0.3)).max() < 1e-3


def test_rules_are_the_paths_of_the_trees_and_weights_the_lasso_optimum(spark, monkeypatch):
    """Rules fired by Spark equal those of plain Python, and the weights meet the lasso's optimality conditions on them."""
    monkeypatch.setattr(rule_ensemble, "TREES", 4)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = rule_ensemble.train(docs, labels)
    rows = rule_ensemble.quality_stats(docs.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0 and label is not null")).select("doc_id", "label", "quality").collect()
    fired = np.array([[all((r.quality[n] > t) if above else (r.quality[n] <= t) for n, above, t in rule) for rule, _ in model.rules] for r in rows], float)
    y, w = np.array([r.label for r in rows], float), np.array([w for _, w in model.rules])
    chance = 1 / (1 + np.exp(-(fired @ w + model.intercept)))
    gradient = fired.T @ (chance - y) / len(y)
    assert np.abs(gradient + rule_ensemble.LASSO * np.sign(w)).max() < 2e-3 and abs((chance - y).mean()) < 2e-3
    scores = {r.doc_id: r.score for r in rule_ensemble.with_score(docs.select("doc_id", "text"), model).collect()}
    assert max(abs(scores[r.doc_id] - c) for r, c in zip(rows, chance, strict=True)) < 1e-9
    for rule, _ in model.rules:  # a path bounds each side of a statistic once, at most as deep as a tree
        assert 0 < len(rule) <= rule_ensemble.DEPTH and len({c[:2] for c in rule}) == len(rule)


def test_rule_ensemble_compiles_rules(spark):
    model = rule_ensemble.RuleEnsemble((((("n_words", True, 2.0), ("symbol_ratio", False, 0.5)), 3.0),), -1.0)
    rows = spark.createDataFrame([(1, "a b c", "q", "s"), (2, "a b # # # c", None, None), (3, None, None, None), (None, "", None, None), (1, "a b c", "q", "s")], DOCS)
    got = rule_ensemble.with_score(rows, model).collect()
    chance = lambda m: 1 / (1 + np.exp(-m))
    assert sorted((r.doc_id or 0, round(r.score, 9)) for r in got) == sorted((i, round(float(chance(m)), 9)) for i, m in ((1, 2.0), (2, 2.0), (3, -1.0), (0, -1.0), (1, 2.0)))
    assert got[0].quality == "q"  # a column of the name of an inner one stays


@pytest.mark.parametrize(("query", "label", "least"), [(op3_quality_ensemble, "quality", 0.95), (op7_toxicity_kernel, "toxic", 0.85)])
def test_held_out_rows_of_the_tables(spark, query, label, least):
    rows = query(spark, SF)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    judged = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([r[label] for r in judged], [r.score for r in judged]) >= least


def test_stages_with_nulls_repeats_clashing_names_and_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = [(None, None, None, None, None), (2**60 + 1, None, None, None, None), (7, "", "en", "s", 0), (2**60 + 3, "one", "en", "s", 3), (2**60 + 3, "one", "en", "s", 3)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in ("score", "_score", "_kept", "quality", "bands", "kept", "piece")})
    kept = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == rows.columns
        kept.write.parquet(f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
        kept = spark.read.parquet(f"{tmp_path}/{len(list(tmp_path.iterdir())) - 1}")
    given = set(map(tuple, rows.collect()))
    assert set(map(tuple, kept.collect())) <= given
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert sorted({str(r.doc_id) for r in packed.collect()}) == sorted({str(r.doc_id) for r in kept.collect()})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.where("false"), SF).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == columns and 0 < kept.count() < before, name
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_training_rows_are_bounded_at_any_size(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    usable = {i for i in range(4000) if zlib.crc32(str(i).encode()) % 5}
    taken = {r.doc_id for r in common.labelled_rows(docs, labels, "toxic", 500).collect()}
    assert taken < usable and 400 < len(taken) < 600
    assert {r.doc_id for r in common.labelled_rows(docs, labels, "toxic", 4000).collect()} == usable
    for total in (30_000_000_000, 10**15, 10**18):  # rows are still taken where labels are very many
        share = common.hash_limit(total, 20_000) / common.hash_limit(1, 1)
        assert share * total == pytest.approx(20_000, rel=1e-3)
    monkeypatch.setattr(common, "hash_limit", lambda total, most, whole=common.hash_limit: whole(30_000_000_000 // 4000 * total, most * 10**7))
    assert 0 < common.labelled_rows(docs, labels, "toxic", 50).count() < 400
    both = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic"))).where("doc_id < 10")
    assert sorted(r.toxic for r in common.labelled_rows(docs, both, "toxic", 100).where("doc_id = 1").collect()) in ([], [0, 1])
