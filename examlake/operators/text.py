"""Text measures and page-to-question mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shares import SHARES, n_shares  # noqa: F401

# Words that tell nothing about a question.
STOP_WORDS = """a about above after again against all am an and any are aren as at be because been before being below between both briefly but
by can cannot could describe detail did difference different discuss do does down during each either example explain few for from
further give had has have having he her here hers herself him himself his how i if in into is it its itself just me more
most my myself no nor not note notes of off on once only or other ought our ours ourselves out over own principle prove same
short should so some state such suitable than that the their theirs them themselves then there these they this those through to too under
until up very was we were what when where which while who whom why with write you your yours yourself yourselves""".split()
# What hides secrets in error messages, pattern and replacement, in this order.
REDACTIONS = ((r"(?i)key=[^&\s]+", "key=REDACTED"), (r"(?i)bearer\s+[^\s]+", "Bearer REDACTED"), (r"(?i)AIza[a-zA-Z0-9_\-]+", "REDACTED"), (r"(?i)AQ\.[a-zA-Z0-9_\-]+", "REDACTED"))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _bits(text: np.ndarray, chars: np.ndarray) -> Iterator[int]:
    """For each of ``chars`` a number with a bit for each place where ``text`` has it."""
    for at in range(0, len(chars), 64):  # so that memory grows with the text alone
        for row in np.packbits(text == chars[at : at + 64, None], axis=1, bitorder="little"):
            yield int.from_bytes(row.tobytes(), "little")


def distance(a: str, b: str) -> int:
    """Edits of characters (Myers' and Hyyro's columns of bits): a step for each character of the shorter text, all of the longer one in one number."""
    if len(a) < len(b):
        a, b = b, a
    if not b or a == b:
        return 0 if a == b else len(a)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b)]
    chars, order = np.unique(codes[1], return_inverse=True)
    places = list(_bits(codes[0], chars))
    score, every, last = len(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down = every, 0  # where a column rises and falls by one
    for k in order.tolist():
        here = places[k]
        flat = (((here & up) + up) ^ up | here | down) & every
        right, left = down | (every ^ (flat | up)), up & flat
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        right = right << 1 | 1
        up, down = (left << 1 | (every ^ ((flat | right) & every))) & every, right & flat
    return score


def edit_distance(a: Column, b: Column) -> Column:
    """Edits of characters between two texts; null where one is. The built-in fills a table of single cells, which takes longer than all else here."""

    @F.pandas_udf("int")
    def edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return edits(a, b)


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits of characters over the reference's length, at least 1; may pass 1."""
    a, b = normalised(reference), normalised(hypothesis)
    return edit_distance(a, b) / F.greatest(F.lit(1), F.char_length(a))


def capped_char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """At most 1; an empty reference gives 0 for an empty hypothesis, else 1."""
    a, b = normalised(reference), normalised(hypothesis)
    n = F.char_length(a)
    return F.when(n == 0, F.when(F.char_length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), edit_distance(a, b) / n))


def redacted(text: Column) -> Column:
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def _edits(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists; a row of the table at a time, its running minimum vectorised."""
    if not a or not b:
        return max(len(a), len(b))
    codes = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    other = np.array([codes[w] for w in b])
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, w in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (other != codes[w]))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits of words over the reference's words, at least 1 (the distance has no built-in for arrays)."""

    @F.pandas_udf("double")
    def rate(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([_edits(x.split(), y.split()) / max(1, len(x.split())) for x, y in zip(a, b, strict=True)], dtype="float64")

    return rate(normalised(reference), normalised(hypothesis))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _telling(word: Column, least: int = 3) -> Column:
    return (F.length(word) >= least) & ~word.isin(STOP_WORDS)


def profile_keywords(text: Column) -> Column:
    """Distinct words that tell something (no stop word, no number): of three letters with hyphens as spaces, of four with hyphens left out."""
    low = F.lower(F.coalesce(text, F.lit("")))
    good = lambda n: lambda w: _telling(w, n) & ~w.rlike("^[0-9]+$")
    return F.array_distinct(F.concat(F.filter(_words(F.replace(low, F.lit("-"), F.lit(" "))), good(3)), F.filter(_words(F.replace(low, F.lit("-"), F.lit(""))), good(4))))


def profile_phrases(text: Column) -> Column:
    """Distinct runs of two and three telling words, hyphens as spaces."""
    words = _words(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("-"), F.lit(" ")))
    good = F.transform(words, lambda w: F.when(_telling(w), w))
    at = lambda i, k: F.get(good, i + k)
    runs = F.transform(good, lambda w, i: F.array(F.when(w.isNotNull() & at(i, 1).isNotNull(), F.concat_ws(" ", w, at(i, 1))), F.when(w.isNotNull() & at(i, 1).isNotNull() & at(i, 2).isNotNull(), F.concat_ws(" ", w, at(i, 1), at(i, 2)))))
    return F.array_distinct(F.array_compact(F.flatten(runs)))


def profile_terms(profiles: DataFrame) -> DataFrame:
    """``question_id``, ``term``, ``phrase`` (whether it is one): a row for each term of each profile."""
    named = F.concat(
        F.transform(profile_keywords(F.col("text")), lambda t: F.struct(t.alias("term"), F.lit(False).alias("phrase"))),
        F.transform(profile_phrases(F.col("text")), lambda t: F.struct(t.alias("term"), F.lit(True).alias("phrase"))),
    )
    return profiles.select("question_id", F.explode(named).alias("t")).select("question_id", "t.*")


def page_terms(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """``page_id``, ``term``: which of ``terms`` stand on each page, as whole words; a phrase with one space (or hyphen) between its words.

    Each page is split into words once (and once more without hyphens, where it has any); words that
    no term has are dropped by a join with the terms' words, and only then are phrases put together.
    What is left is dealt by page, to more tasks the more there is to read, so a task's share doesn't grow with the input.
    """
    low = F.lower("text")
    forms = F.array_compact(F.array(F.replace(low, F.lit("-"), F.lit(" ")), F.when(F.contains(low, F.lit("-")), F.replace(low, F.lit("-"), F.lit("")))))
    # What is neither a word's letter nor a space stands as a word of its own, so it keeps its neighbours apart.
    split = pages.select("page_id", F.posexplode(forms).alias("form", "t")).select("page_id", "form", F.posexplode(F.split(F.regexp_replace("t", "[^a-z0-9_ ]", " | "), " ")).alias("at", "word"))
    known = terms.select(F.explode(F.split("term", " ")).alias("word")).distinct()
    kept = split.where("word <> '' and word <> '|'").join(known, "word")
    dealt = kept.repartition(n_shares(pages), "page_id")
    words = dealt.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("form", "at", "word"))).alias("w"))
    nxt = lambda x, i, k: F.when((F.get("w", i + k).getField("form") == x.form) & (F.get("w", i + k).getField("at") == x.at + k), F.get("w", i + k).getField("word"))
    grams = F.transform("w", lambda x, i: F.array(x.word, F.concat(x.word, F.lit(" "), nxt(x, i, 1)), F.concat(x.word, F.lit(" "), nxt(x, i, 1), F.lit(" "), nxt(x, i, 2))))
    return words.select("page_id", F.explode(F.array_distinct(F.array_compact(F.flatten(grams)))).alias("term"))


def explicit_header(text: Column) -> Column:
    """The number in the first question header (``Q3``, ``Ans. 3``, ``3)`` at a line's start), or null; ASCII word borders."""
    found = F.regexp_extract(text, r"(?im)(?:^|[^A-Za-z0-9_])(?:q(?:uestion)?|ans(?:wer)?)[.\s]*([0-9]{1,3})(?![A-Za-z0-9_])", 1)
    numbered = F.regexp_extract(text, r"(?m)^[ ]*([0-9]{1,3})[).]", 1)
    return F.coalesce(F.when(found != "", found), F.when(numbered != "", numbered)).cast("int")


def page_numbers(spec: Column) -> Column:
    """Page lists such as ``"3, 5-7 9"`` as sorted distinct numbers; parts that are none are left out."""
    parts = F.filter(F.split(spec, r"[,\s]+"), lambda p: p.rlike("^[0-9]{1,6}(-[0-9]{1,6})?$"))
    bounds = F.transform(parts, lambda p: F.split(p, "-"))
    spans = F.transform(bounds, lambda b: F.sequence(F.least(b[0].cast("int"), F.element_at(b, -1).cast("int")), F.greatest(b[0].cast("int"), F.element_at(b, -1).cast("int"))))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]*"
# Every number that a header gives: "question 3", "ans #3"; "3) a"; "q.3". Borders are of ASCII words.
_HEADERS = (
    rf"(?:question|q|ans|answer){_SPACE}#?{_SPACE}([0-9]+)(?![A-Za-z0-9_])",
    rf"(?<![A-Za-z0-9_])([0-9]+){_SPACE}[.)-]{_SPACE}(?=[a-z])",
    rf"(?<![A-Za-z0-9_])q\.?{_SPACE}([0-9]+)(?![A-Za-z0-9_])",
)


def header_numbers(text: Column) -> Column:
    """All distinct numbers in question headers anywhere in the text, as written."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.lower(text), F.lit(p), 1) for p in _HEADERS]))


def page_scores(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """``page_id``, ``question_id``, ``hits`` (keywords), ``phrases`` and ``score`` of each pair that shares a term.

    0.25 for each phrase, at most 0.55; 0.55 times the share of keywords; 0.15, 0.25 and 0.35 more for two, three and four keywords; at most 0.98.
    """
    terms = profile_terms(profiles)
    sizes = terms.groupBy("question_id").agg(F.greatest(F.lit(1), F.count_if(~F.col("phrase"))).alias("n_keywords"))
    found = page_terms(pages, terms).join(terms, "term").groupBy("page_id", "question_id").agg(F.count_if(~F.col("phrase")).alias("hits"), F.count_if("phrase").alias("phrases"))
    hits = F.col("hits")
    boost = F.when(hits >= 4, 0.35).when(hits >= 3, 0.25).when(hits >= 2, 0.15).otherwise(0.0)
    score = F.least(F.lit(0.98), F.least(F.lit(0.55), 0.25 * F.col("phrases")) + 0.55 * hits / F.col("n_keywords") + boost)
    return found.join(sizes, "question_id").select("page_id", "question_id", "hits", "phrases", score.alias("score"))


def _passes(least: float) -> Column:
    return (F.col("score") >= least) | ((F.col("hits") >= 3) & (F.col("score") >= 0.4))


def _confidence(score: Column) -> Column:
    return F.least(F.lit(0.96), F.greatest(F.lit(0.7), score + 0.15))


def map_pages(pages: DataFrame, profiles: DataFrame, least: float = 0.5) -> DataFrame:
    """Best question of each page by shared profile terms.

    ``pages``: ``page_id``, ``text``; ``profiles``: ``question_id``, ``text``. Pages that share no term
    with any profile, or score below ``least``, give no row. Ties go to the smaller question.
    """
    best = F.max(F.struct(F.col("score"), (-F.col("question_id")).alias("q"), F.col("hits"), F.col("phrases")))
    by_page = page_scores(pages, profiles).where(_passes(least)).groupBy("page_id").agg(best.alias("b"))
    return by_page.select("page_id", (-F.col("b.q")).alias("question_id"), F.col("b.hits").alias("hits"), F.col("b.phrases").alias("phrases"), F.col("b.score").alias("score"), _confidence(F.col("b.score")).alias("confidence"))


def page_headers(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """``page_id``, ``question_id`` of each question that a header on the page names."""
    named = pages.select("page_id", F.explode(header_numbers(F.col("text"))).alias("number"))
    return named.join(profiles.select("question_id", F.col("question_id").cast("string").alias("number")), "number").select("page_id", "question_id")


def combined(headers: DataFrame, scores: DataFrame, least: float = 0.5) -> DataFrame:
    pairs = headers.withColumn("header", F.lit(True)).join(scores.where(_passes(least)), ["page_id", "question_id"], "full_outer")
    source = F.when(F.col("header"), "AUTO_EXPLICIT").otherwise("AUTO_SEMANTIC")
    return pairs.select("page_id", "question_id", "hits", "phrases", "score", source.alias("source"), F.when(F.col("header"), 0.85).otherwise(_confidence(F.col("score"))).alias("confidence"))


def map_page_questions(pages: DataFrame, profiles: DataFrame, least: float = 0.5) -> DataFrame:
    """Every question of each page: those that a header on it names, and those that share enough profile terms.

    Takes what :func:`map_pages` takes. ``hits``, ``phrases`` and ``score`` are null where the header alone tells.
    """
    return combined(page_headers(pages, profiles), page_scores(pages, profiles), least)


# What tells that a page goes on.
CUES = ("continued", "contd", "example:", "for example", "algorithm:", "steps:", "advantages:", "disadvantages:", "diagram:", "hence proven", "code:")


def continuations(pages: DataFrame, mapped: DataFrame, headers: DataFrame, scores: DataFrame) -> DataFrame:
    """Pages behind a mapped one that go on with its question, one step.

    A page of at least 20 characters that names no other question in a header and shares two keywords, a
    phrase or a score of 0.35 with the question, or one keyword where it has a cue; pairs that are
    mapped already give no row.
    """
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(F.lower("text"), F.lit(c))
    following = mapped.select((F.col("page_id") + 1).alias("page_id"), "question_id", "confidence").join(mapped.select("page_id", "question_id"), ["page_id", "question_id"], "left_anti")
    long = pages.where(F.char_length(F.trim("text")) >= 20).select("page_id", cue.alias("cue"))
    own = following.join(scores, ["page_id", "question_id"]).join(long, "page_id")
    own = own.where((F.col("hits") >= 2) | (F.col("phrases") >= 1) | (F.col("score") >= 0.35) | (F.col("cue") & (F.col("hits") >= 1)))
    of_page = headers.groupBy("page_id").agg(F.min("question_id").alias("low"), F.max("question_id").alias("top"))
    clear = own.join(of_page, "page_id", "left").where("low is null or (low = question_id and top = question_id)")
    return clear.select("page_id", "question_id", "hits", "phrases", F.lit("AUTO_CONTINUATION").alias("source"), "confidence")
