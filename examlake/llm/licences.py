"""Licence scan by diagonal voting.

Every rolling k-gram of words is hashed and joined to the positions of the same
gram in a small set of templates. A match votes for the diagonal (place in the text
minus place in the template); diagonals next to each other are merged. Spans are verified on
the words themselves: a vote counts only where its words equal the template's, and a
span only where the template words that stand in it cover enough of the template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, text_or_empty

_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """``exact`` templates count only where all their words stand consecutively."""

    name: str
    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        import re

        return [w for w in re.split("[^0-9a-z]+", self.text.lower()) if w]

    @property
    def k(self) -> int:
        return 2 if self.exact else 4


#: The base phrases.
BASE = (
    Template("mit license", "mit", "mit license", True),
    Template("apache license", "apache", "apache license", True),
    Template("general public license", "gpl", "general public license", True),
)
# Names, notices and terms of widely used public licences.
MORE = (
    Template("cc-by-nc", "cc-by-nc", "licensed under cc by nc", True),
    Template("cc-by-sa", "cc-by-sa", "licensed under cc by sa", True),
    Template("cc-by", "cc-by", "creative commons attribution", True),
    Template("mpl", "mpl", "mozilla public license", True),
    Template("bsd", "bsd", "bsd license", True),
    Template("reserved", "all-rights-reserved", "all rights reserved", True),
    Template(
        "mit-text",
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
        " to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template(
        "apache-text",
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in"
        " writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific"
        " language governing permissions and limitations under the license",
    ),
    Template("apache-notice", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template(
        "gpl-text",
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the"
        " license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or"
        " fitness for a particular purpose see the gnu general public license for more details",
    ),
    Template("gpl-notice", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template(
        "bsd-text",
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the"
        " above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc-text", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense-text", "unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    Template("mpl-text", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
)
TEMPLATES = BASE + MORE


#: Hash of the ``n`` words from place ``i`` of ``_h``, the hashes of single words.
_HASH = {2: "xxhash64(2, _h[i], _h[i + 1])", 4: "xxhash64(4, slice(_h, i + 1, 4))"}


def _template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """A row for each gram of each template; its size is fixed by the templates."""
    rows = [(n, t.k, i, t.words[i : i + t.k]) for n, t in enumerate(templates) for i in range(len(t.words) - t.k + 1)]
    hashed = spark.createDataFrame(rows, "template int, k int, t_at int, words array<string>").withColumns({"_h": F.transform("words", lambda w: F.xxhash64(w)), "i": F.lit(0)})
    return hashed.select("template", "t_at", F.expr(f"if(k = 2, {_HASH[2]}, {_HASH[4]})").alias("hash"), F.array_join("words", " ").alias("gram"), "k")


def _hash_list(grams: DataFrame) -> str:
    return ", ".join(sorted({f"{r.hash}L" if r.hash > -(2**63) else "(-9223372036854775807L - 1L)" for r in grams.select("hash").collect()}))  # a few hundred, fixed by the templates


def find_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, min_cover: float = 0.6, max_shift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Returns ``(texts, spans)``.

    ``texts``: a row for each different pair of id and text: the id, ``row`` (id and digest of the text,
    so the same however rows are dealt or read again), ``n_rows`` (how often it stands in ``docs``) and
    ``n_words``. ``spans``: ``row``, ``template`` (place in ``templates``), ``first_word``,
    ``last_word``, ``cover`` (share of the template's grams found). An exact template is found where
    all its words stand consecutively; another where the grams on neighbouring diagonals (at most
    ``max_shift`` apart) cover ``min_cover`` of it.

    Words are runs of digits, a-z (A-Z is lower-cased) and characters beyond ASCII. A null or empty
    text has no words and no spans; an empty table gives two empty tables. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    row = F.struct(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("digest"))
    texts = docs.select(row.alias("row"), F.filter(F.split(ascii_lower(text), _BREAKS), lambda w: w != "").alias("_words"))
    hashed = texts.select("row", "_words", F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    known = _template_grams(spark, templates)
    listed = _hash_list(known)
    # Each place gives the hashes of its two grams; the words themselves are put together only where a template has the hash.
    # sequence() runs downwards where its end is below its start; such short texts have no grams.
    hashes = f"if(size(_h) < 2, cast(array() as array<array<bigint>>), transform(sequence(0, size(_h) - 2), i -> array({_HASH[2]}, if(i + 3 < size(_h), {_HASH[4]}, null))))"
    gram = lambda j, k: f"struct(p[{j}] as hash, if(p[{j}] in ({listed}), array_join(slice(_words, i + 1, {k}), ' '), null) as gram)"
    grams = hashed.select("row", F.posexplode(F.expr(f"transform({hashes}, (p, i) -> array({gram(0, 2)}, {gram(1, 4)}))")).alias("at", "_pair")).select("row", "at", F.inline("_pair"))
    votes = grams.join(F.broadcast(known), ["hash", "gram"]).withColumn("diagonal", F.col("at") - F.col("t_at"))
    by_diagonal = votes.groupBy("row", "template", "diagonal").agg(F.collect_set("t_at").alias("t_ats"), F.min("at").alias("low"), F.max(F.col("at") + F.col("k") - 1).alias("high"))
    traits = spark.createDataFrame([(n, t.exact, len(t.words) - t.k + 1) for n, t in enumerate(templates)], "template int, exact boolean, n_grams int")
    placed = by_diagonal.join(F.broadcast(traits), "template")
    # One pass for both kinds: each diagonal of an exact template is a run of its own.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > max_shift)
    spans = (
        placed.withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(0)))
        .withColumn("_run", F.sum("_new").over(order))
        .groupBy("row", "template", "_run")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("t_ats")))).alias("_n"), F.min("low").alias("first_word"), F.max("high").alias("last_word"), F.first("n_grams").alias("n_grams"), F.first("exact").alias("exact"))
        .withColumn("cover", F.col("_n") / F.col("n_grams"))
        .where(F.when(F.col("exact"), F.col("_n") == F.col("n_grams")).otherwise(F.col("cover") >= min_cover))
        .select("row", "template", "first_word", "last_word", "cover")
    )
    counts = texts.groupBy("row").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("_words")).cast("long").alias("n_words"))
    return counts.select(F.col("row.id").alias(id_col), "row", "n_rows", "n_words"), spans


def licence_report(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[Template, ...] = BASE, **options) -> DataFrame:
    """A row for each row of ``docs``: places of the base phrases, labels and a score.

    ``score`` is the best cover of any span (0: none). A text without spans gets empty labels. Rows
    that repeat get equal results, one for each.
    """
    texts, spans = find_licences(docs, templates, **options)
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    is_base = F.col("template").isin([n for n, t in enumerate(templates) if t in base])
    found = spans.groupBy("row").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, label))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    whole = texts.join(found, texts["row"].eqNullSafe(found["row"]), "left").drop("row")
    return whole.withColumn("n_rows", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int")))).drop("n_rows").fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
