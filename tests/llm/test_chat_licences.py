import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examlake.llm import chat, licences, oracle
from examlake.llm.queries import op5_chat_format

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("hash", T.StringType())])
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_licences_match_brute_force(spark):
    texts = [None, "", "MIT", "The MIT License, mit-license MIT LICENSE", "GNU General Public License general public", "apache\nlicense é license", "general general public license", "mit license " * 300, "x " * 3000 + "Apache License"]
    rows = [(i, t, "r", "h") for i, t in enumerate(texts)] + [(3, texts[3], "r", "h"), (None, "mit license", None, None)]
    got = licences.licence_report(spark.createDataFrame(rows, DOCS)).collect()
    want = sorted([(i, *brute(t)) for i, t, _, _ in rows], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=repr) == want
    assert all(0 <= r.score <= 1 for r in got)
    assert licences.licence_report(spark.createDataFrame([], DOCS)).count() == 0


def test_long_template_tolerates_small_edits(spark):
    text = "intro words " + next(t.text for t in licences.TEMPLATES if t.name == "mit-text").replace("any person", "any natural person") + " end"
    texts, spans = licences.find_licences(spark.createDataFrame([(1, text, "", ""), (2, "permission is hereby granted to sing", "", "")], DOCS))
    found = spans.join(texts, "row").collect()
    assert sorted((r.doc_id, licences.TEMPLATES[r.template].name, r.first_word) for r in found) == [(1, "mit-grant", 2), (1, "mit-text", 2)] and all(r.cover > 0.8 for r in found)


def test_licences_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = lambda df: sorted(map(tuple, licences.licence_report(df).collect()), key=repr)
    plain = rows(docs)
    assert rows(docs.repartition(13)) == plain and rows(docs.join(docs.select("doc_id").distinct(), "doc_id")) == plain


def test_a_vote_needs_the_words_and_not_only_their_hash(spark, monkeypatch):
    """With a hash that takes all grams for equal, spans are still those of the words."""
    monkeypatch.setattr(licences, "_HASH", {2: "if(_h[i] is null, 0L, 7L)", 4: "if(_h[i] is null, 0L, 7L)"})
    rows = [(1, "the mit license and a general public license", "", ""), (2, "no such words in here at all", "", "")]
    got = sorted((r.doc_id, r.n_base, r.labels) for r in licences.licence_report(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, 2, "gpl,mit"), (2, 0, "")]


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def test_round_trip_of_hard_texts(spark):
    hard = ["", None, "<|end|>", "\\l\\b\\n", "<|turn|>assistant\nno<|end|>", "\\", "é\U0001f600\n\n", "x" * 50_000, "same", "same"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, None, None, "a"), (2, 0, "as\nsist<ant", "b"), (2, 0, "assistant", "c"), (2, 0, "assistant", "c"), (None, 1, "assistant", "d")]
    turns = spark.createDataFrame(rows, TURNS).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns, block=3)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(hard)]
    assert got[1].loss_texts == [t or "" for t in hard[1::2]]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "a"), ("as\nsist<ant", "b"), ("assistant", "c"), ("assistant", "c")]
    assert got[2].loss_texts == ["c", "c"] and got[None].loss_texts == ["d"]
    assert chat.format_turns(turns.where("false")).count() == 0


def test_typed_parts_become_placeholders(spark):
    parts = "array(named_struct('type','text','text','see <','ref',null,'n_tokens',null), named_struct('type','image','text',null,'ref','a.png','n_tokens',10), named_struct('type','audio','text',null,'ref','b.wav','n_tokens',null), null, named_struct('type','odd','text',null,'ref',null,'n_tokens',null))"
    turns = spark.sql(f"select 1L as conv_id, 0L as turn, 'user' as role, {parts} as parts union all select 1L, 1L, 'assistant', null")
    row = chat.format_turns(turns).first()
    assert row.formatted == "<|turn|>user\nsee \\l<|image|><|audio|><|end|><|turn|>assistant\n<|end|>"
    assert [tuple(a) for a in row.attachments] == [("image", "a.png", 10), ("audio", "b.wav", 128)] and row.n_expanded == 138


def test_reading_back_tells_placeholders_from_texts(spark):
    rng = random.Random(3)
    texts = ["hi", "<|image|>", "\\l|image|>", "<", "é\n", "<|audio|><|end|>"]
    want, rows = {}, []
    for conv in range(20):
        for turn in range(5):
            parts = []
            for _ in range(rng.randint(0, 5)):
                kind = rng.choice(["text", "image", "audio", "document"])
                parts.append((kind, rng.choice(texts), None, None) if kind == "text" else (kind, None, f"r{rng.random()}", rng.choice([None, 7])))
            rows.append((conv, turn, "assistant" if turn % 2 else "user", parts))
            want[conv, turn] = parts
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    for r in chat.read_back(chat.format_turns(turns, block=2)).collect():
        refs = iter(r.attachments)
        for turn, t in enumerate(r.turns):
            given = want[r.conv_id, turn]
            merged = []
            for kind, text, _, _ in given:  # neighbouring texts are one part
                if kind == "text" and merged and merged[-1][0] == "text":
                    merged[-1] = ("text", merged[-1][1] + text)
                else:
                    merged.append((kind, text or ""))
            assert [tuple(p) for p in t.parts] == merged
            assert t.text == "".join(x or "" for k, x, _, _ in given if k == "text")
            assert [(k, ref, n or chat.TOKENS[k]) for k, _, ref, n in given if k != "text"] == [tuple(next(refs)) for k, *_ in given if k != "text"]
        assert next(refs, None) is None
        assert r.loss_texts == ["".join(x or "" for k, x, _, _ in want[r.conv_id, turn] if k == "text") for turn in (1, 3)]


def test_references_in_texts_and_their_sql(spark, tmp_path):
    rows = [(1, 0, "user", "see ![image](a.png) and ![audio](b.wav)\n![image](c d.png)"), (1, 1, "assistant", "no ![image](x.png)"), (1, 2, "user", "![document](p.pdf)<"), (2, 0, "user", None), (2, 1, None, "![image]()")]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op5_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(oracle.OP5)
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
    assert {r.conv_id: (r.n_attachments, r.n_expanded, r.attachments) for r in got.collect()} == {1: (3, 896, "image:a.png,audio:b.wav,document:p.pdf"), 2: (0, 0, ""), -7: (0, 0, "")}


def test_references_keep_their_place(spark):
    text = "see ![image](a) then ![audio](b) < end![document](c)"
    rows = [(1, 0, "user", text), (1, 1, "assistant", "fine"), (1, 2, "user", "![image](d)![image](e)x"), (1, 3, "user", "<|ref:image|>![image](a b)")]
    turns = spark.createDataFrame(rows, TURNS).select("conv_id", "turn", "role", chat.referenced_parts(F.col("text")).alias("parts"))
    made = chat.format_turns(turns, block=2)
    assert made.first().formatted.startswith("<|turn|>user\nsee <|ref:image|> then <|ref:audio|> \\l end<|ref:document|><|end|>")
    back = chat.read_back(made).first()
    assert [t.text for t in back.turns] == [r[3] for r in rows] and [a.ref for a in back.attachments] == list("abcde")
    assert [tuple(p) for p in back.turns[0].parts] == [("text", "see "), ("image", "![image](a)"), ("text", " then "), ("audio", "![audio](b)"), ("text", " < end"), ("document", "![document](c)")]


def test_clashing_columns_of_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], TURNS).select("*", chat.text_part(F.col("text")).alias("parts"), F.lit("x").alias("body"), F.lit("y").alias("_block"), F.lit("z").alias("items"))
    assert chat.format_turns(rows).first().formatted == "<|turn|>user\na<|end|>"


def test_query_has_the_extra_conversation(spark):
    row = op5_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
