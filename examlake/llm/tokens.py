"""Byte-pair encoding by forced boundaries.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never be
merged across, so the cut between them is certain. A word is cut there, its fragments are
encoded independently (each seen fragment and word once per task, then from a cache that is
bounded in bytes) and the ids are put together again. Texts are split at ASCII white space,
across which nothing composes or merges; inside such a run the tokenizer's own normalizer
and splitter decide. Spark deals the texts to tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Bytes that a worker's cache of words may take, about. Bounds memory, never results.
CACHE_BYTES = 56_000_000
#: What an entry takes beside its key and ids.
_ENTRY_BYTES = 200


# Kinds of bytes of plain texts: white space, (parts of) letters, digits, the apostrophe, others; and between which two of them words part.
_KIND = np.array([1 if chr(b).isalpha() or b >= 0x80 else 0 if chr(b).isspace() else 2 if chr(b).isdigit() else 3 if b == 39 else 4 for b in range(256)], np.uint8)
_PARTED = np.array([a > 0 and b > 0 and (a == b == 2 or (a != b and {a, b} != {3, 4} and (a, b) != (3, 1))) for a in range(5) for b in range(5)])


class _Seen(dict):
    """Ids (bytes) by what was encoded; ``encode`` gives those of what is new, and whether to keep them.

    Beyond half of ``CACHE_BYTES`` a new generation begins; the one before is still looked up, so what is frequent stays.
    """

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.held, self.before = encode, 0, {}

    def __missing__(self, key):
        ids = self.before.get(key)
        if ids is None:
            ids, keep = self.encode(key)
            if not keep:
                return ids
        self.keep(key, ids)
        return ids

    def keep(self, key, ids: bytes) -> None:
        if len(key) <= 64:
            self.held += _ENTRY_BYTES + len(key) + len(ids)
            if 2 * self.held > CACHE_BYTES:
                self.before = dict(self)
                self.clear()
                self.held = 0
            self[key] = ids

    def known(self, key) -> bytes | None:
        ids = self.get(key)
        if ids is None and (ids := self.before.get(key)) is not None:
            self.keep(key, ids)
        return ids


class FragmentEncoder:
    """Encodes as the tokenizer file at ``path`` does, without adding special tokens.

    Ids are handed on as little-endian unsigned 32-bit integers in bytes: joining those of the words
    is joining bytes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path = path
        spec = self._spec()
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.last = self._model(model, end_of_word_suffix=suffix)
        split = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.normal, self.split = split.normalizer.normalize_str, split.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        inside = {t.removesuffix(suffix) for t in model["vocab"]}
        self.joined = {t[i : i + 2] for t in inside for i in range(len(t) - 1)}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(1 + max(model["vocab"].values()))]
        self._learn_letters()
        self.words, self.fragments = _Seen(self._word), _Seen(self._fragment)
        self.runs = _Seen(lambda run: (self._together([run])[0], True))

    def _learn_letters(self) -> None:
        """Letters below U+0300 (nothing there composes with its neighbours) that the tokenizer treats as Python does."""
        one = lambda c: [p for p, _ in self.split(self.normal(f"a{c}b"))]
        plain = {c for c in map(chr, range(0x80, 0x300)) if len(c.lower()) == 1 and self.normal(c) == c.lower() and len(one(c)) == 1}
        letters = "".join(sorted(c for c in plain if c.lower() in plain))
        self.is_plain = re.compile(f"[!-~{letters}]+").fullmatch
        # The splitter's pattern, for words of these letters and ASCII, lower-cased.
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9]|[^a-z0-9{letters}]+").findall
        self.is_plain_text = re.compile(f"[\t-\r -~{letters}]*").fullmatch
        self.shown = str.maketrans({c: one(c)[0][1:-1] for c in letters if c == c.lower()})

    def _spec(self) -> dict:
        return json.load(open(self.path, encoding="utf-8"))

    @staticmethod
    def _model(model: dict, **options):
        from tokenizers import models

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options)

    @cached_property
    def inner(self):
        """The model without word ends, loaded when a first word is cut."""
        return self._model(self._spec()["model"])

    @cached_property
    def bulk(self):
        """Encodes words that blanks part, and says nothing of offsets; and which ids end a word."""
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        spec = self._spec()
        suffix = spec["model"]["end_of_word_suffix"]
        if not suffix:
            raise ValueError("words are told apart by the suffix of their last token, and this vocabulary has none")
        tokenizer = Tokenizer(self.last)
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(len(self.id_bytes), bool)
        ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        return tokenizer.encode_batch_fast, ends

    @cached_property
    def plain(self):
        """The library's tokenizer, loaded for decoding."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def _ids(self, tokens) -> bytes:
        return b"".join([self.id_bytes[t.id] for t in tokens])

    def _fragment(self, fragment: str) -> tuple[bytes, bool]:
        """Ids of a fragment that a certain cut ends."""
        return self._ids(self.inner.tokenize(fragment)), True

    def _piece(self, s: str) -> bytes:
        """Ids of a word of the splitter, its bytes shown as the vocabulary shows them."""
        joined = self.joined
        cuts = [i for i, pair in enumerate(zip(s, s[1:], strict=False), 1) if pair[0] + pair[1] not in joined]
        if not cuts:
            return self._ids(self.last.tokenize(s))
        inner = [self.fragments[s[a:b]] for a, b in zip([0, *cuts], cuts, strict=False)]
        return b"".join(inner) + self._ids(self.last.tokenize(s[cuts[-1] :]))

    def _word(self, run: bytes) -> tuple[bytes, bool]:
        """Ids of a run without ASCII white space. A run of several words is not kept, only those words."""
        if run.isalpha():  # of bytes: letters of ASCII alone
            return self._piece(run.lower().decode()), True
        text = run.decode()
        if not self.is_plain(text):
            return b"".join([self._piece(piece) for piece, _ in self.split(self.normal(text))]), True
        pieces = self.pieces(text.lower())
        if len(pieces) == 1:
            return self._piece(pieces[0].translate(self.shown)), True
        return b"".join([self.words[p.encode()] for p in pieces]), False

    def text_bytes(self, text: str) -> bytes:
        """Ids of a whole text, as bytes."""
        if "<|" in text and self.at_special.search(text):
            return b"".join([self.special.get(part) or self.text_bytes(part) for part in self.at_special.split(text) if part])
        raw = text.encode()
        # Letters beyond ASCII may compose with a capital in one way and with its small letter in another, so such texts keep their case here.
        return b"".join(map(self.words.__getitem__, (raw.lower() if text.isascii() else raw).split()))

    def _together(self, runs: list[str]) -> list[bytes]:
        """Ids of runs without white space; the words of all of them in one call. A word's last token alone has the suffix of words, so it tells where the next begins."""
        encode, ends_word = self.bulk
        words, counts, apart = [], [0], {}
        for i, run in enumerate(runs):
            if not self.is_plain(run):
                apart[i] = self.words[run.encode()]
            elif run.isalpha():
                words.append(run.lower())
            else:
                words += self.pieces(run.lower())
            counts.append(len(words))
        ids = np.array(encode([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.concatenate([[0], 4 * (np.flatnonzero(ends_word[ids]) + 1)])
        if len(ends) != len(words) + 1:
            raise ValueError(f"{len(words)} words gave {len(ends) - 1} ends of words")
        raw, at = ids.tobytes(), ends[counts].tolist()
        out = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        for i, ids_ in apart.items():
            out[i] = ids_
        return out

    def _cut(self, texts: list[str]) -> pa.Array:
        """The texts, plain ones in small letters and with blanks where the splitter parts their words for certain. After an apostrophe it may go on, so the letters behind one stay with it."""
        plain = [self.is_plain_text(t) is not None for t in texts]
        # Case stays where letters may compose, as in ``text_bytes``.
        whole = pa.array([t.lower() if p else t for t, p in zip(texts, plain, strict=True)], pa.large_string())
        offsets, raw = np.frombuffer(whole.buffers()[1], np.int64)[: len(texts) + 1], np.frombuffer(whole.buffers()[2] or b"", np.uint8)
        raw = raw[: offsets[-1]]
        kind = _KIND[raw]
        cut = _PARTED[kind[:-1] * 5 + kind[1:]]
        for i, p in enumerate(plain):
            if not p:
                cut[max(0, offsets[i] - 1) : offsets[i + 1]] = False
        places = np.flatnonzero(cut) + 1
        parted = np.insert(raw, places, 32)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets + np.searchsorted(places, offsets)), pa.py_buffer(parted))

    def texts_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as bytes: what ``text_bytes`` gives for each. Equal runs are looked up once, and new ones go through the model together.

        Takes some multiple of the texts' size at once, so hand over as many as memory allows.
        """
        apart = {i for i, t in enumerate(texts) if "<|" in t and self.at_special.search(t)}
        split = pc.ascii_split_whitespace(self._cut([t if i not in apart else "" for i, t in enumerate(texts)]))
        distinct = split.flatten().dictionary_encode()
        runs = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.runs.known, runs))
        if new := [i for i, ids in enumerate(found) if ids is None]:
            for i, ids in zip(new, self._together([runs[i] for i in new]), strict=True):
                found[i] = ids
                self.runs.keep(runs[i], ids)
        flat, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = distinct.indices.to_numpy()
        n = lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in apart:
            out[i] = self.text_bytes(texts[i])
        return out

    def text_ids(self, text: str) -> list[int]:
        return np.frombuffer(self.text_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.plain.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> FragmentEncoder:
    """One encoder for each tokenizer file and worker process."""
    return FragmentEncoder(path)


def with_token_ids(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``, the token ids of each whole text (array of int; null or empty text: none).

    Rows are encoded one by one, so ties, repeats and nulls elsewhere make no difference, and an
    empty table gives an empty result. A column named ``out_col`` is replaced; the others stay.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = encoder(tokenizer_path).text_bytes
        for texts in batches:
            yield pd.Series([np.frombuffer(ids(t), np.int32) for t in texts])

    return docs.withColumn(out_col, encode(text_or_empty(text_col)))


def with_decoded(ids: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the text that ``ids_col`` decodes to (special tokens shown; null: empty)."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = encoder(tokenizer_path).decode
        for rows in batches:
            yield pd.Series([text(r.tolist()) if r is not None else "" for r in rows])

    return ids.withColumn(out_col, decode(F.col(ids_col)))


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text.

    Encodes, decodes and digests in one pass, so ids need not leave the task.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer_path)
        for texts in batches:
            ids = [coder.text_bytes(t) for t in texts]  # as the digest wants them: little-endian, unsigned, 32 bits
            yield pd.DataFrame({
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(coder.decode(np.frombuffer(i, "<u4").tolist()).encode()).hexdigest() for i in ids],
            })

    return docs.select(id_col, digest(text_or_empty(text_col)).alias("d")).select(id_col, "d.*")
