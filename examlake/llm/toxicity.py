"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Strings are words with their borders. Two words are alike as far as they share subsequences
of three to five characters, each gap costing a factor (up to two characters may lie inside one of
four, one inside others); so an insult with inserted, dropped or starred
characters still resembles the plain one, and single letters set apart
are read as one word. A word's kernel values against landmark words, whitened, are the
features of a linear machine trained on the words of labelled sentences (a word bears
the labels of the texts it stands in, so words common in clean texts weigh against). As the
machine is linear in the landmarks and the kernel in the subsequences, it is compiled into
one weight for each subsequence: scoring is a table look-up over the characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, labelled_rows, releasing, text_or_empty

#: Labelled training rows at most; chosen by a hash of the id.
MAX_ROWS = 20_000
#: Landmarks, toxic and clean, at most.
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 256, 64
#: Distinct words of the labelled rows that the machine is fitted on at most, chosen by a hash of the word.
MAX_WORDS = 40_000
#: Weight of all words of toxic texts against those of clean texts, and the machine's ridge for each word seen.
TOXIC_SHARE, RIDGE = 0.4, 2e-7
#: What a text's second highest word may count against its highest; the calibration rows choose.
SECOND = (0.0, 0.25, 0.5, 1.0)
#: Characters that may lie inside a subsequence, by its length.
MAX_GAPS = {3: 1, 4: 2, 5: 1}
#: Subsequence patterns (places from the first character) by length: the last place tells the gaps.
PATTERNS = {n: tuple(sorted(p for p in combinations(range(1, n + g), n - 1))) for n, g in MAX_GAPS.items()}
GAP = 0.6
_BITS = 20
_DROP = 255
#: Texts of about so many characters are scored at once.
_CHUNK = 400_000


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code point -> 0 (white space), 1-63 (letters; look-alike signs as letters) or _DROP."""
    out = np.full(0x110000, _DROP, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isspace():
            out[cp] = 0
        elif c.isalpha():
            out[cp] = cp - 96 if "a" <= c <= "z" else 27 + cp % 37
    # Signs that stand for letters.
    for sign, letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
        out[ord(sign)] = ord(letter) - 96
    return out


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts as codes, words set apart by single 0s (one at either end); and each text's first place."""
    raw = "".join([f" {t.lower()} " for t in texts]).encode("utf-32-le", "surrogatepass")
    lengths = np.array([len(t.lower()) + 2 for t in texts])
    codes = _alphabet()[np.minimum(np.frombuffer(raw, "<u4"), 0x10FFFF)]
    text = np.repeat(np.arange(len(texts)), lengths)
    starts = np.zeros(len(codes), bool)
    starts[np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(int)] = True
    keep = codes != _DROP
    codes, text, starts = codes[keep], text[keep], starts[keep]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | starts[1:]
    codes, text, starts = codes[keep], text[keep], starts[keep]
    # A space between two single letters goes.
    zero = codes == 0
    apart = np.zeros(len(codes), bool)
    apart[2:-2] = zero[2:-2] & zero[:-4] & ~zero[1:-3] & ~zero[3:-1] & zero[4:] & ~starts[2:-2]
    keep = ~apart
    return codes[keep], np.flatnonzero(starts[keep])


def _indices(codes: np.ndarray) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    """For each pattern: length, weight, table index of the subsequence at each place, and whether it stays in its word."""
    n = len(codes)
    wide = np.concatenate((codes, np.zeros(8, np.uint8))).astype(np.uint32)
    border = np.flatnonzero(np.concatenate((codes, [0])) == 0)
    room = border[np.searchsorted(border, np.arange(n), side="right").clip(max=len(border) - 1)] - np.arange(n)
    room = room.astype(np.int8 if n < 100 else np.int32)
    for length, patterns in PATTERNS.items():
        for places in patterns:
            index = wide[:n].copy()
            for p in places:
                index *= np.uint32(64)
                index += wide[p : n + p]
            if 6 * length > _BITS:
                index *= np.uint32(0x9E3779B1)
                index >>= np.uint32(32 - _BITS)
            yield length, GAP ** (places[-1] - length + 1), index, room >= places[-1]


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of subsequences by length (index, value), the bias, and the calibration of the two highest words."""

    weights: dict[int, tuple[np.ndarray, np.ndarray]]
    bias: float
    calibration: tuple[float, float, float]

    def tables(self) -> dict[int, np.ndarray]:
        out = {}
        for length, (index, value) in self.weights.items():
            out[length] = np.zeros(1 << _BITS, np.float32)
            out[length][index] = value
        return out


def word_margins(codes: np.ndarray, tables: dict[int, np.ndarray], bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the borders before each word, and the machine's margin for each."""
    total = np.zeros(len(codes), np.float32)
    for length, weight, index, inside in _indices(codes):
        got = tables[length][index]
        got *= inside
        if weight != 1:
            got *= np.float32(weight)
        total += got
    words = np.flatnonzero((codes[:-1] == 0) & (codes[1:] != 0))
    if not len(words):
        return words, np.empty(0, np.float32)
    # A word's subsequences begin at its border or inside it; those from the border behind it are the next word's.
    sums = np.add.reduceat(total, words)
    return words, sums + np.float32(bias)


def top_two(texts: list[str], tables: dict[int, np.ndarray], bias: float) -> np.ndarray:
    """The two highest word margins of each text (the bias where there is no such word)."""
    out = np.full((len(texts), 2), bias, np.float32)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
            size += len(texts[end])
            end += 1
        codes, starts = codes_of(texts[at:end])
        words, margins = word_margins(codes, tables, bias)
        if len(words):
            owner = np.searchsorted(starts, words, side="right") - 1
            order = np.lexsort((-margins, owner))
            first = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1])))
            out[at + owner[order][first], 0] = margins[order][first]
            second = first + 1
            ok = second < len(order)
            ok[ok] = owner[order][second[ok]] == owner[order][first[ok]]
            out[at + owner[order][first[ok]], 1] = margins[order][second[ok]]
        at = end
    return out


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            codes, _ = codes_of([text])
            (toxic if label else clean).update({w for w in (codes + 48).astype(np.uint8).tobytes().split(b"0") if len(w) > 1})
        if len(toxic) + len(clean) > 300_000:
            yield _counted(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield _counted(toxic, clean)


def _counted(toxic: Counter, clean: Counter) -> pd.DataFrame:
    words = list(toxic | clean)
    return pd.DataFrame({"word": pd.Series([w.decode() for w in words], dtype=object), "t": [toxic[w] for w in words], "c": [clean[w] for w in words]})


def _codes_of_words(words: list[str]) -> np.ndarray:
    joined = "0" + "0".join(words) + "0"
    return np.frombuffer(joined.encode(), np.uint8) - np.uint8(48)


def _kernel_rows(words: list[str], features: dict[int, np.ndarray], matrix: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark, whitened, a block of words at a time.

    ``features`` maps a table index to its row in ``matrix``, or -1.
    """
    out = np.zeros((len(words), whiten.shape[1]), np.float32)
    for start in range(0, len(words), 2000):
        block = words[start : start + 2000]
        kernel = np.zeros((len(block), matrix.shape[1]), np.float32)
        codes = _codes_of_words(block)
        owner = np.cumsum(codes == 0) - 1
        for length, weight, index, inside in _indices(codes):
            row = features[length][index]
            hit = np.flatnonzero(inside & (row >= 0) & (owner < len(block)))
            for part in np.array_split(hit, max(1, len(hit) // 4_000)):
                if len(part):
                    who, first = np.unique(owner[part], return_index=True)
                    kernel[who] += np.add.reduceat(matrix[row[part]] * np.float32(weight), first, axis=0)
        out[start : start + 2000] = kernel @ whiten
    return out


def _landmark_features(landmarks: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray, list[tuple[int, int]]]:
    """Rows of the landmarks' subsequences, the weight of each in each landmark, and (length, index) of each row."""
    rows: dict[tuple[int, int], int] = {}
    entries: list[tuple[int, int, float]] = []
    patterns = [(length, places) for length, some in PATTERNS.items() for places in some]
    for k, mark in enumerate(landmarks):
        codes = np.frombuffer(f"0{mark}".encode(), np.uint8) - np.uint8(48)
        for (length, places), (_, weight, index, _) in zip(patterns, _indices(codes), strict=True):
            for i in range(len(codes) - places[-1]):  # a landmark is open at its end: no subsequence takes the border there
                entries.append((rows.setdefault((length, int(index[i])), len(rows)), k, weight))
    matrix = np.zeros((len(rows), len(landmarks)), np.float32)
    for r, k, w in entries:
        matrix[r, k] += w
    features = {length: np.full(1 << _BITS, -1, np.int32) for length in PATTERNS}
    for (length, index), r in rows.items():
        features[length][index] = r
    return features, matrix, list(rows)


def _svm(x: np.ndarray, up: np.ndarray, down: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge machine by Newton's method; ``up`` and ``down`` weigh each row as +1 and as -1.

    Rows are taken a block at a time, so beside ``x`` only a block and the normal matrix are held.
    """
    n, m = x.shape
    beta = np.zeros(m + 1)
    penalty = np.full(m + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        gradient, normal = penalty * beta, np.diag(penalty)
        for start in range(0, n, 2048):
            rows = slice(start, start + 2048)
            block = np.hstack((x[rows].astype(np.float64), np.ones((len(x[rows]), 1))))
            f = block @ beta
            a, b = up[rows] * (f < 1), down[rows] * (f > -1)
            gradient += block.T @ (a * (f - 1) + b * (f + 1))
            normal += (block * (a + b)[:, None]).T @ block
        step = np.linalg.solve(normal, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack((x, np.ones((len(x), 1))))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + ridge * np.r_[beta[:-1], 0]
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.diag([*[1.0] * (len(beta) - 1), 1e-6]), gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> ToxicityModel | None:
    """Fits on ``labels.toxic`` (``doc_id``, ``toxic``) and the texts of ``docs``.

    Four fifths of at most about ``max_rows`` labelled rows give words, landmarks and the machine; the
    rest the calibration. The machine is fitted on at most ``max_words`` distinct words of those rows,
    whose counts are of all of them; where there are more, those that begin like a landmark are taken
    more often. None if a class is missing or no beginning of a word tells the classes apart (few, unlike
    texts): then nothing can be learnt.
    """
    rows = labelled_rows(docs, labels, "toxic", max_rows).withColumn("fifth", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))
    words = checkpointed(rows.where("fifth <> 0").select("text", "toxic").mapInPandas(releasing(_words), "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    total = words.agg(F.sum("t"), F.sum("c"), F.count(F.lit(1))).first()
    t_all, c_all, n_words = (x or 0 for x in total)
    if not t_all or not c_all:
        return None
    parts = F.array_distinct(F.array(*[F.substring("word", 1, k) for k in (3, 4, 5, 6, 8, 12)]))
    marks = words.select(F.explode(parts).alias("mark"), "t", "c").where(F.length("mark") >= 3).groupBy("mark").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio = F.log((F.col("t") / t_all) / ((F.col("c") + 0.5) / c_all))
    marks = checkpointed(marks.where("t >= 2 or c >= 5").withColumn("ratio", F.coalesce(ratio, F.lit(-9.0))))
    due = (F.col("t") + F.col("c")) * t_all / (t_all + c_all)  # what its frequency alone makes likely
    toxic = marks.where((F.col("t") >= 2) & (F.col("ratio") > 1.6) & (F.col("t") - due > 3 * F.sqrt(due))).orderBy((F.col("t") * F.col("ratio")).desc(), "mark").limit(TOXIC_LANDMARKS)
    clean = marks.where("ratio < 1").orderBy(F.col("c").desc(), "mark").limit(CLEAN_LANDMARKS)
    toxic_marks = [r.mark for r in toxic.select("mark").collect()]  # bounded lists
    landmarks = toxic_marks + [r.mark for r in clean.select("mark").collect()]
    if not toxic_marks:
        return None
    near = F.arrays_overlap(parts, F.lit(landmarks).cast("array<string>"))
    keep = F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.6 * max_words / n_words))
    taken = words.where(keep | near).orderBy(F.xxhash64("word")).limit(max_words).collect()  # the documented bound

    features, matrix, places = _landmark_features(landmarks)
    gram = matrix.T.astype(np.float64) @ matrix
    values, vectors = np.linalg.eigh(gram)
    ok = values > 1e-6 * values.max()
    whiten = vectors[:, ok] / np.sqrt(values[ok])
    known = _kernel_rows([r.word for r in taken], features, matrix, whiten.astype(np.float32))
    beta = _svm(known, TOXIC_SHARE * c_all / t_all * np.array([r.t for r in taken], float), np.array([r.c for r in taken], float), RIDGE * (t_all + c_all))
    by_place = matrix @ (whiten @ beta[:-1]).astype(np.float32)
    weights = {}
    for length in PATTERNS:
        at = [i for i, (n, _) in enumerate(places) if n == length]
        weights[length] = (np.array([places[i][1] for i in at], np.int64), by_place[at].astype(np.float32))
    model = ToxicityModel(weights, float(beta[-1]), (2.0, 0.0, 0.0))
    held = rows.where("fifth = 0").select("doc_id", "text", "toxic").mapInPandas(releasing(_tops(model)), "doc_id long, toxic int, first float, second float").drop("doc_id").collect()  # max_rows / 5
    y = np.array([r.toxic for r in held])
    if min(y.sum(), len(y) - y.sum()) >= 3:
        top = np.clip([[r.first, r.second] for r in held], -1.5, 1.5)
        fits = []
        for share in SECOND:
            z = top[:, :1] + share * top[:, 1:]
            a, c = _logistic(z, y, ridge=0.1)
            right = 1 / (1 + np.exp(-(a * z[:, 0] + c)))
            fits.append((int(((right >= 0.5) != y).sum()), float(-np.log(np.clip(np.where(y == 1, right, 1 - right), 1e-9, 1)).sum()), float(a), share, float(c)))
        _, _, a, share, c = min(fits)
        if a > 0:
            model = ToxicityModel(weights, model.bias, (a, share * a, c))
    return model


def _tops(model: ToxicityModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = model.tables()
        for batch in batches:
            top = top_two(batch["text"].tolist(), tables, model.bias)
            yield batch.drop(columns=["text"]).assign(first=top[:, 0], second=top[:, 1])

    return run


def with_score(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col`` (0 to 1) for each whole text; a column of that name is replaced.

    A text without words gets the score of words that resemble no landmark; without a model (no
    labels of both kinds) every score is 0. Equal texts get equal scores; no other column is read.
    """
    if model is None:
        return docs.withColumn(out_col, F.lit(0.0))
    a, b, c = model.calibration

    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tables = model.tables()
            for texts in batches:
                top = np.clip(top_two(texts.tolist(), tables, model.bias), -1.5, 1.5).astype(np.float64)
                yield pd.Series(1 / (1 + np.exp(-(a * top[:, 0] + b * top[:, 1] + c))))

        yield from releasing(run)(batches)

    return docs.withColumn(out_col, chance(text_or_empty(text_col)))
