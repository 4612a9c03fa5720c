"""Threshold rules over text statistics, compiled into projections of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The most frequent function words of each language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so what".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ses mais comme ou si leur y dont tout nous sa été cette aux elle".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo".split(),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose ``stat`` is below ``low`` or above ``high``."""

    stat: str
    low: float | None = None
    high: float | None = None

    def passes(self, value: Column) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= F.lit(float(self.low)))
        if self.high is not None:
            ok = ok & (value <= F.lit(float(self.high)))
        return ok


#: The default table. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("upper_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.3),
)

_WS = "[\\x20\\x09-\\x0D]+"
_WINDOW = 5


def _with_counts(df: DataFrame, text: Column) -> DataFrame:
    """Adds the base counts; each ``withColumns`` names an array once, so it is computed once."""
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    df = df.withColumn("_text", text)
    df = df.withColumns({
        "_words": F.filter(F.split("_text", _WS), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda s: F.regexp_like(s, F.lit("[^\\x20\\x09-\\x0D]"))),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda s: F.rtrim(s).endswith("...") | F.rtrim(s).endswith("…"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(stops))).cast("long"),
        "n_upper": (F.char_length("_text") - F.char_length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_lower": (F.char_length("_text") - F.char_length(F.translate("_text", "abcdefghijklmnopqrstuvwxyz", ""))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    # Places covered by a window of five words that stands twice or more: sort (hash, place),
    # keep those with an equal neighbour, and add up the places between one and the next.
    df = df.withColumn(
        "_windows",
        F.expr(f"if(n_words < {_WINDOW}, array(), transform(sequence(0, n_words - {_WINDOW}), i -> xxhash64({', '.join(f'_hashes[i + {k}]' for k in range(_WINDOW))})))"),
    )
    df = df.withColumn(
        "_sorted",
        F.expr("if(size(array_distinct(_windows)) = size(_windows), cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))))"),
    )
    df = df.withColumn(
        "_twice",
        F.expr("sort_array(transform(filter(_sorted, (x, i) -> (i > 0 and _sorted[i - 1].h = x.h) or (i < size(_sorted) - 1 and _sorted[i + 1].h = x.h)), x -> x.i))"),
    )
    return df.withColumn(
        "n_repeat_words",
        F.expr(f"if(size(_twice) = 0, 0L, aggregate(zip_with(_twice, slice(_twice, 2, size(_twice)), (a, b) -> least(coalesce(b - a, {_WINDOW}), {_WINDOW})), 0L, (s, x) -> s + x))"),
    )


def quality_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` of counts and ratios of its whole text.

    Words are runs without ASCII white space; a null text counts as empty. No column of
    ``docs`` is read but the text, and none is replaced except one named ``quality``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_or_empty(text_col).alias("_in"))
    counted = _with_counts(rows, F.col("_in"))
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    stats = {
        **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")},
        "mean_word_chars": F.col("word_chars") / words,
        "distinct_word_ratio": F.col("n_distinct_words") / words,
        "repeat_word_ratio": F.col("n_repeat_words") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_word_ratio": (F.col("n_stop_words") + 0.5) / words,  # half a word more: a very short text may have none
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "ellipsis_line_ratio": F.col("n_ellipsis_lines") / lines,
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
    }
    # Through explode no filter on the statistics is pushed down, where it would repeat all of the expressions above for each use.
    quality = F.explode(F.array(F.struct(*[v.alias(k) for k, v in stats.items()]))).alias("quality")
    return counted.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "quality"], quality)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Adds ``quality`` (statistics), ``base_failed``, ``failed_rules`` (names) and ``kept``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in five-word windows that
    repeat. An empty or null text fails. Rows are judged one by one: ties, repeats and rows with
    nulls elsewhere make no difference; an empty table gives an empty result. Columns of the four
    names are replaced, all others stay.
    """
    scored = quality_stats(docs, text_col)
    failed = F.array_compact(F.array(*[F.when(~r.passes(F.col(f"quality.{r.stat}")), F.lit(r.stat)) for r in rules]))
    base = (F.col("quality.n_words") < 10) | (100 * F.col("quality.n_repeat_words") > 20 * F.col("quality.n_words"))
    out = scored.withColumns({"failed_rules": failed, "base_failed": base})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
