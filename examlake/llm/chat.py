"""Chat formatting with typed content parts.

A turn is a list of parts; a visitor (one case for each type) turns text into escaped
text and an image, audio or document into an ordered placeholder, and notes the
attachment's reference and the tokens that the placeholder expands to. A part that a text
referred to stands where the reference stood, with a placeholder of its own kind, so reading
back puts the reference into the text again. Escaping writes
``\\`` as ``\\b``, ``<`` as ``\\l`` and a line break inside a role as ``\\n``, so no text can
hold a control string, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, CLOSE = "<|turn|>", "\n", "<|end|>"
ATTACHMENTS = ("image", "audio", "document")
#: In a placeholder: the part was a reference in a text.
IN_TEXT = "ref:"
#: Tokens that a placeholder expands to where a part names none.
TOKENS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type: string, text: string, ref: string, n_tokens: int>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escaped(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def flatten_parts(parts: Column) -> Column:
    """Struct of ``body``, ``attachments`` (type, ref, tokens, in order) and ``n_expanded``.

    A null part, an unknown type without text and a null text give nothing; an unknown type with a
    text counts as text. An attachment with a text was a reference in a text: ``![type](ref)``.
    """
    is_attachment = lambda p: p.type.isin(list(ATTACHMENTS))
    default = F.create_map(*[x for k, v in TOKENS.items() for x in (F.lit(k), F.lit(v))])
    given = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    body = F.array_join(F.transform(given, lambda p: F.when(is_attachment(p), F.concat(F.lit("<|"), F.when(F.coalesce(p.text, F.lit("")) != "", IN_TEXT).otherwise(""), p.type, F.lit("|>"))).otherwise(escaped(F.coalesce(p.text, F.lit(""))))), "")
    attachments = F.transform(F.filter(given, is_attachment), lambda p: F.struct(p.type.alias("type"), p.ref.alias("ref"), F.coalesce(p.n_tokens, default[p.type]).alias("n_tokens")))
    return F.struct(body.alias("body"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a.n_tokens).alias("n_expanded"))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


def format_turns(turns: DataFrame, block: int = 64) -> DataFrame:
    """Formats ``turns`` (``conv_id``, ``turn``, ``role``, ``parts``) into a row for each conversation.

    Returns ``conv_id``, ``formatted``, ``loss_spans`` (start, length of each assistant body, code
    points from 0), ``attachments`` and ``n_expanded``. Turns stand in ascending ``turn``, then role
    and body; nulls come first. Rows that repeat are all kept; a null ``conv_id`` is a conversation of
    its own; an empty table gives no rows.

    A long conversation is put together in two steps, by blocks of ``block`` turn numbers and then
    whole, so that one with a large share of all rows is dealt to many tasks first.
    """
    flat = turns.select("conv_id", "turn", _role(F.col("role")).alias("role"), flatten_parts(F.col("parts")).alias("p"))
    piece = F.concat(F.lit(OPEN), F.col("role"), F.lit(HEAD_END), F.col("p.body"), F.lit(CLOSE))
    item = F.struct("turn", "role", F.col("p.body").alias("body"), piece.alias("piece"), F.col("p.attachments").alias("attachments"), F.col("p.n_expanded").alias("n_expanded"))
    blocks = flat.groupBy("conv_id", F.floor(F.col("turn") / block).alias("_block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    joined = blocks.select(
        "conv_id",
        F.struct(
            "_block",
            F.array_join(F.transform("items", lambda x: x.piece), "").alias("formatted"),
            F.transform("items", lambda x: F.struct(F.char_length(x.piece).alias("n"), F.when(x.role == "assistant", F.char_length(x.body)).alias("loss"))).alias("sizes"),
            F.flatten(F.transform("items", lambda x: x.attachments)).alias("attachments"),
            F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x.n_expanded).alias("n_expanded"),
        ).alias("b"),
    )
    whole = joined.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs")).withColumn("_sizes", F.flatten("bs.sizes"))
    # Running ends: an assistant body ends before the closing mark of its turn.
    spans = F.aggregate(
        "_sizes",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans")),
        lambda s, x: F.struct(
            (s.at + x.n).alias("at"),
            F.when(x.loss.isNull(), s.spans).otherwise(F.concat(s.spans, F.array(F.struct((s.at + x.n - x.loss - len(CLOSE)).alias("start"), x.loss.cast("long").alias("length"))))).alias("spans"),
        ),
        lambda s: s.spans,
    )
    return whole.select("conv_id", F.array_join("bs.formatted", "").alias("formatted"), spans.alias("loss_spans"), F.flatten("bs.attachments").alias("attachments"), F.aggregate("bs.n_expanded", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_expanded"))


#: Pieces of a body: a placeholder, or a run of escaped text (which holds no ``<``).
_PIECES = r"<\|(?:ref:)?(?:image|audio|document)\|>|[^<]+"


def _pieces(body: Column) -> Column:
    """The pieces of a body, in order: ``type``, ``text`` and whether the piece was a reference in a text."""
    is_ref = lambda p: p.startswith(f"<|{IN_TEXT}")
    begin = lambda p: F.when(is_ref(p), 3 + len(IN_TEXT)).otherwise(3)
    return F.transform(
        F.regexp_extract_all(body, F.lit(_PIECES), F.lit(0)),
        lambda p: F.when(p.startswith("<|"), F.struct(F.substring(p, begin(p), F.char_length(p) - begin(p) - 1).alias("type"), F.lit("").alias("text"), is_ref(p).alias("in_text"))).otherwise(
            F.struct(F.lit("text").alias("type"), unescaped(p).alias("text"), F.lit(False).alias("in_text"))
        ),
    )


def read_parts(body: Column) -> Column:
    """The typed parts that a body was made from, in order: (``type``, ``text``); neighbouring texts are one part, empty ones none."""
    return F.transform(_pieces(body), lambda p: F.struct(p.type.alias("type"), p.text.alias("text")))


def _restored(pieces: Column, before: Column) -> Column:
    """Parts (type, text) of a turn with ``before`` attachments in the turns before it; references in texts have their text again."""
    nth = lambda i: before + F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda q: q.type != "text")) - 1
    source = lambda p, i: F.concat(F.lit("!["), p.type, F.lit("]("), F.get(F.col("attachments"), nth(i)).ref, F.lit(")"))
    return F.transform(pieces, lambda p, i: F.struct(p.type.alias("type"), F.when(p.in_text, source(p, i)).otherwise(p.text).alias("text")))


def _part_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p.text), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss_spans`` alone: ``turns`` (role, text, parts) and ``loss_texts``.

    ``parts`` has the type of each part, so a placeholder differs from a text that looks like one; its
    reference and tokens are the entry of ``attachments`` of the same order. ``text`` joins the texts,
    references in them as they stood, and leaves other attachments out, as ``loss_texts`` do.
    """
    raw = F.filter(F.split("formatted", "<\\|turn\\|>"), lambda s: s != "")
    turns = F.transform(
        raw,
        lambda s: F.struct(
            _unrole(F.substring_index(s, HEAD_END, 1)).alias("role"),
            _pieces(F.substring(s, F.instr(s, F.lit(HEAD_END)) + 1, F.char_length(s) - F.instr(s, F.lit(HEAD_END)) - len(CLOSE))).alias("pieces"),
        ),
    )
    # Where attachments begin in each turn; conversations without any need no counting.
    count = lambda t: F.size(F.filter(t.pieces, lambda p: p.type != "text"))
    running = F.aggregate(
        F.col("_turns"), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, t: F.struct((s.at + count(t)).alias("at"), F.concat(s.starts, F.array(s.at)).alias("starts")), lambda s: s.starts,
    )
    starts = F.when(F.size("attachments") > 0, running)
    parts = lambda t, i: _restored(t.pieces, F.coalesce(F.get(F.col("_starts"), i), F.lit(0)))
    whole = F.transform(F.col("_turns"), lambda t, i: F.struct(t.role.alias("role"), parts(t, i).alias("parts")))
    said = F.transform(F.col("_whole"), lambda t: F.struct(t.role.alias("role"), _part_text(t.parts).alias("text"), t.parts.alias("parts")))
    loss = F.transform("loss_spans", lambda x: _part_text(read_parts(F.substring(F.col("formatted"), (x.start + 1).cast("int"), x.length.cast("int")))))
    held = formatted.withColumn("_turns", turns).withColumn("_starts", starts).withColumn("_whole", whole)
    return held.withColumns({"turns": said, "loss_texts": loss}).drop("_turns", "_starts", "_whole")


_REFERENCE = r"!\[(?:image|audio|document)\]\([^()\s]+\)"


def referenced_parts(text: Column) -> Column:
    """A text as parts in its own order: texts, and where it refers to something, ``![image](place)``, ``![audio](place)`` or ``![document](place)``, a part of that type."""
    given = F.coalesce(text, F.lit(""))
    of_text = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens"))
    of_ref = lambda m: F.struct(F.regexp_extract(m, r"\[([a-z]+)\]", 1).alias("type"), m.alias("text"), F.regexp_extract(m, r"\(([^()\s]+)\)", 1).alias("ref"), F.lit(None).cast("int").alias("n_tokens"))
    texts, found = F.split(given, _REFERENCE, -1), F.regexp_extract_all(given, F.lit(_REFERENCE), F.lit(0))
    pairs = F.flatten(F.zip_with(texts, found, lambda t, m: F.array(of_text(t), F.when(m.isNotNull(), of_ref(m)))))
    return F.when(F.instr(given, F.lit("![")) > 0, F.filter(pairs, lambda p: p.isNotNull())).otherwise(text_part(text))
