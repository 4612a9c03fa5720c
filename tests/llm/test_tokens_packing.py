import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from examlake.llm import packing, tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("length", T.StringType())])
ODD = ["", " ", "ΑΣ ΟΔΟΣ", "a\x1cb", "it's we'll 'S", "<|endoftext|>x<|startoftext|> a<|endoftext", "e\u0301A\u030a", "İstanbul ǅ", "日本語", "😀👍🏽 ok!!", "a\u0085b", "\ufeffx", "ﬁ Ω K", "\x00a\x01", "12ab34½²", "ß ẞ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    rng, mine = random.Random(5), tokens.encoder(PATH)
    chars = "abcXYZ'  \n\t<|>019éÉßΣσ\u0301\u200d\x1d\x85日😀İqzx"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["q" * 5000]
    assert [t for t in texts if mine.text_ids(t) != library.encode(t, add_special_tokens=False).ids] == []
    assert any(a + b not in mine.joined for a in "qzx" for b in "qzxj")  # forced cuts do occur


def test_every_code_point_equals_the_library(library):
    mine = tokens.encoder(PATH)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    for k in range(0, len(points), 4000):
        texts = [f"a{chr(c)}b J{chr(c)} {chr(c)}X" for c in points[k : k + 4000]]
        want = library.encode_batch(texts, add_special_tokens=False)
        assert [hex(c) for c, t, w in zip(points[k : k + 4000], texts, want, strict=True) if mine.text_ids(t) != w.ids] == []


def test_a_full_cache_changes_no_ids(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 3000)
    mine, rng = tokens.FragmentEncoder(PATH), random.Random(9)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcqzé.'", k=rng.randint(1, 9))) for _ in range(20))
        assert mine.text_ids(text) == library.encode(text, add_special_tokens=False).ids
        assert len(mine.words) + len(mine.words.before) < 40


def test_many_texts_at_once_equal_the_library(library, monkeypatch):
    parts = ["'", "'s", "''s", ",'s", "don't", "'super", "o'neil", "12", "3a", "É", "straße", "—", "“q”", "日本", "A\u030a", "İ", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "\r\n", "  ", "word", "WORD", "</w>", "x" * 200, "9" * 90, "½"]
    rng = random.Random(5)
    texts = ["", "'", "\n\n", *("".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(600))]
    coder = tokens.FragmentEncoder(PATH)
    single = []
    monkeypatch.setattr(coder, "_piece", lambda s, cut=coder._piece: single.append(s) or cut(s))
    for size in (1, 7, len(texts)):
        got = [ids for i in range(0, len(texts), size) for ids in coder.texts_bytes(texts[i : i + size])]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    single.clear()
    assert coder.texts_bytes([]) == []
    assert coder.texts_bytes(["Some words, never seen: zyxwv ñandú"])[0] and not single  # plain words go together, not one by one


def test_digests(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(None, None, None, None), (1, ODD[1], "x", "y"), (99, "word " * 20_000, "", "")]
    got = tokens.token_digests(spark.createDataFrame(rows, DOCS), PATH).collect()
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokens.token_digests(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_ids_column_and_decoding(spark, library):
    docs = spark.createDataFrame([(1, "Hello there, World", "old", ""), (2, None, "old", "")], DOCS)
    got = {r.doc_id: r for r in tokens.with_decoded(tokens.with_token_ids(docs, PATH), PATH).collect()}
    assert list(got[1].ids) == library.encode("Hello there, World", add_special_tokens=False).ids
    assert got[1].decoded == library.decode(list(got[1].ids), skip_special_tokens=False)
    assert list(got[2].ids) == [] and got[2].decoded == ""


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_places_every_piece(spark, library):
    rng = random.Random(1)
    words = "the of law apple river".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 40, 90, 500]))), None, "7") for i in range(300)] + [(None, None, None, None), (5, "the", None, None), (5, "the", None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = packing.pack_documents(docs, PATH, 128).collect()
    want = []
    for i, t, _, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for k, s in enumerate(range(0, len(ids), 128))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    whole = len(packing.best_fit([w[3] for w in want], 128))
    assert check_packed(got, 128) == whole
    tree = packing.pack_documents(docs, PATH, 128, fan_in=2, hand_on=5).collect()
    assert sorted([(r.doc_id, r.piece) for r in tree], key=repr) == sorted([w[:2] for w in want], key=repr)
    assert check_packed(tree, 128) <= whole * 1.1


def test_ids_beyond_doubles_beside_nulls_and_columns_of_inner_names(spark):
    big = 2**60
    rows = [(big + 1, "the", "a", "b"), (None, "of", None, None), (big + 3, "law", "c", "d")]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).coalesce(1), PATH).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (big + 1, None, big + 3)))
    inner = ["row", "deal", "part", "bin", "shift", "fill", "first", "_bin", "_part", "group"]
    pieces = spark.range(9).select((F.lit(big) + F.col("id")).alias("id"), F.lit(3).alias("length"), *[F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in inner])
    packed = packing.pack(pieces, 10)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    for r in packed.collect():
        assert r.id >= big and all(r[n] == f"{n}{r.id - big}" for n in inner)
    assert check_packed(packed.collect(), 10) == 3


def test_packing_of_clustered_lengths(spark):
    i = F.col("id")
    rows = spark.range(6000, numPartitions=6).select("id", F.when(i < 3000, 1100 + i % 200).otherwise(700 + i % 200).alias("length"))
    got = packing.pack(rows).collect()
    assert sorted(r.id for r in got) == list(range(6000))
    assert check_packed(got, 2048) <= 1.02 * len(packing.best_fit([r.length for r in rows.collect()], 2048))


def test_packing_of_nothing_and_best_fit(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0
    assert sorted(map(sorted, packing.best_fit([6, 4, 5, 5, 10], 10))) == [[0, 1], [2, 3], [4]]
    same = spark.range(1000).select("id", F.lit(3).alias("length"), F.lit("x").alias("offset"))
    assert check_packed(packing.pack(same, 10).collect(), 10) <= 340
