import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from examlake.llm import byte_bpe
from examlake.llm.queries import op11_word_shuffle_bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ODD = ["", " ", "  ", "\n\n x", "it's we'll 'S 's'", "a\x1cb", "a\x85 b　c", "é é", "日本語 漢字12", "😀👍🏽 ok!!", "²½Ⅷ x²", "\x00", "<|endoftext|>", "a " * 50, "ab12ab34", "՘ࢗ꟎", "𝒜𝟙 𐐀", "tab\t\tx \t y"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def text_ids(text):
    mine = byte_bpe.encoder(PATH)
    return [i for words in byte_bpe.splitter().words(text) for w in words for i in mine.ids(w.encode())]


def test_ids_equal_the_library(library):
    rng = random.Random(3)
    chars = "abcXYZ'  \n\t019éÉßΣσ́‍\x1d\x85日😀İqzxst!?.,²½՘"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(3000)] + ["q" * 700, "ab" * 3000, "xyzzy" * 300 + "é" * 400]
    assert [t for t in texts if text_ids(t) != library.encode_ordinary(t)] == []


def test_every_code_point_is_split_as_the_library_splits(library):
    for lo in range(0, 0x110000, 0x1000):
        points = [c for c in range(lo, lo + 0x1000) if not 0xD800 <= c < 0xE000 and (c < 0x40000 or c % 61 == 0)]  # no letters in most of what lies beyond
        text = "\n".join(f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}! {chr(c)} x" for c in points)
        assert text_ids(text) == library.encode_ordinary(text), hex(lo)


def test_long_words_merge_as_short_ones():
    rng, mine = random.Random(9), byte_bpe.encoder(PATH)
    for _ in range(300):
        word = "".join(rng.choice("aabbcinthe") for _ in range(rng.randint(2, 200))).encode()
        assert mine._merged(word) == mine._merged_long(word)


def test_stretches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "STRETCH", 7)
    for text in [*ODD, "one two  three\n\n four's  \t five" * 20, "unbroken" * 9]:
        assert text_ids(text) == library.encode_ordinary(text)


def test_documents_round_trip(spark, library):
    rng = random.Random(4)
    texts = [*ODD, None, None, "the " * 30_000, *[" ".join(rng.choice(["the", "of", "Größe", "naïve", "zq" * rng.randint(1, 4)]) for _ in range(rng.randint(0, 80))) for _ in range(60)]]
    rows = [(None if n % 9 == 4 else n % 40, t, "x", None) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, block long").repartition(3)
    got = byte_bpe.encode_documents(docs, PATH, block_chars=300).collect()
    want = sorted(((r[0], tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows), key=repr)
    assert sorted(((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got), key=repr) == want


def test_empty_table_and_string_ids(spark, library):
    docs = spark.createDataFrame([("k", "abc def")], "name string, body string")
    assert byte_bpe.encode_documents(docs.where("false"), PATH, "name", "body").count() == 0
    row = byte_bpe.encode_documents(docs, PATH, "name", "body").withColumn("listed", byte_bpe.id_list()).first()
    assert (row["name"], row["listed"]) == ("k", library.encode_ordinary("abc def"))


def test_decoding_joins_the_token_table(spark):
    tokens = byte_bpe.token_table(spark, PATH)
    rows = [(1, [262, 262, 10]), (2, []), (3, None), (1, [262, 262, 10])]
    got = byte_bpe.decoded(spark.createDataFrame(rows, "k int, ids array<int>"), tokens).collect()
    names = {v: k for k, v in byte_bpe.read_ranks(PATH).items()}
    assert sorted((r.k, bytes(r.decoded)) for r in got) == sorted((k, b"".join(names[i] for i in ids or [])) for k, ids in rows)


def test_query_over_the_table(spark, library):
    got = {r.doc_id: r for r in op11_word_shuffle_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d.text), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
