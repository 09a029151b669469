"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from its letters' vectors, each
rotated by its place, by multiplying them; a text is the bundle (sum) of its n-grams, a language the
bundle of its texts. A text gets the language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import crc32_mod, filter_rows, kept, map_rows, map_texts

DIMENSIONS = 1024
SYMBOLS = 64            # 0 is whatever is no letter, 1 to 26 are a to z, the rest share the other letters
SLICE = 1 << 20         # characters of a text in memory as symbols at a time
MEMORY_ROWS = 1 << 15   # n-gram vectors that a worker keeps
MAX_LANGUAGES = 10_000
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2


class Space:
    """Letter vectors and, as they are met, vectors of the letter trigrams."""

    def __init__(self, dimensions: int, seed: int) -> None:
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.place = np.full(SYMBOLS ** 3, -1, dtype=np.int32)
        self.rows = np.empty((0, dimensions), dtype=np.float32)
        self.used = 0
        self.symbol = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                self.symbol[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 % (1 << 32) >> 8) % (SYMBOLS - 27)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // SYMBOLS ** 2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        return (self.first[a] * self.second[b] * self.third[c]).astype(np.float32)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """A row per code. They are kept up to a fixed number; the rest are bound each time."""
        new = codes[self.place[codes] < 0][:MEMORY_ROWS - self.used]
        if len(new):
            if self.used + len(new) > len(self.rows):
                grown = np.empty((min(MEMORY_ROWS, 2 * (self.used + len(new))), self.rows.shape[1]), dtype=np.float32)
                grown[:self.used] = self.rows[:self.used]
                self.rows = grown
            self.rows[self.used:self.used + len(new)] = self.bind(new)
            self.place[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        at = self.place[codes]
        if at.min() >= 0:
            return self.rows[at]
        out = np.empty((len(codes), self.rows.shape[1]), dtype=np.float32)
        out[at >= 0] = self.rows[at[at >= 0]]
        out[at < 0] = self.bind(codes[at < 0])
        return out

    def trigrams(self, text: str) -> Iterator[np.ndarray]:
        """Codes of the trigrams over letters and single gaps, slice by slice; nothing for a text without letters."""
        tail = np.zeros(1, dtype=np.uint8)
        for start in range(0, len(text), SLICE):
            points = np.frombuffer(text[start:start + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
            s = np.concatenate([tail, self.symbol[points]])
            if start + SLICE >= len(text):
                s = np.append(s, np.uint8(0))
            keep = np.ones(len(s), dtype=bool)
            keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
            s = s[keep].astype(np.int32)
            if len(s) >= 3:
                yield s[:-2] * SYMBOLS ** 2 + s[1:-1] * SYMBOLS + s[2:]
            tail = s[-2:].astype(np.uint8)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.unique(c, return_counts=True) for c in self.trigrams(text)]
        if len(parts) < 2:
            return parts[0] if parts else (np.empty(0, np.int32), np.empty(0, np.int64))
        codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def space(dimensions: int, seed: int) -> Space:
    """One per Python worker."""
    return kept(("space", dimensions, seed), lambda: Space(dimensions, seed))


@dataclass
class Profiles:
    """Unit prototypes, one row per language, languages in alphabetical order."""

    languages: list[str]
    prototypes: np.ndarray
    dimensions: int
    seed: int


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", dimensions: int = DIMENSIONS, seed: int = 7) -> Profiles:
    """Prototypes from all rows with a text and a language; anything else is passed over.

    Each task counts its trigrams per language and bundles them once, exactly, in whole numbers; what is
    shuffled is one number per task, language and dimension. More than ``MAX_LANGUAGES`` languages are
    an error, since the prototypes are then no longer a small table.
    """
    def bundle(source: Iterator[dict]) -> Iterable[tuple]:
        s = space(dimensions, seed)
        totals: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(name: str) -> None:
            codes, n = np.unique(np.concatenate(waiting.pop(name)), return_counts=True)
            total = totals.setdefault(name, np.zeros(dimensions, dtype=np.int64))
            for i in range(0, len(codes), 4096):
                total += (n[i:i + 4096].astype(np.float64) @ s.vectors(codes[i:i + 4096])).astype(np.int64)
            size[name] = 0

        for r in source:
            for codes in s.trigrams(r["t"]):
                waiting.setdefault(r["l"], []).append(codes)
                size[r["l"]] = size.get(r["l"], 0) + len(codes)
                if size[r["l"]] > 1 << 21:
                    flush(r["l"])
        for name in list(waiting):
            flush(name)
        for name, total in totals.items():
            for i, x in enumerate(total.tolist()):
                yield name, i, x

    rows = docs.select(F.col(lang).alias("l"), F.col(text).alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    parts = map_rows(rows, bundle, "l string, i int, x bigint")
    sums = parts.groupBy("l", "i").agg(F.sum("x").alias("x")).groupBy("l").agg(
        F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("v"))      # a fixed number of entries per language
    found = sorted((r["l"], r["v"]) for r in sums.limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    vectors = np.array([v for _, v in found], dtype=np.float64).reshape(len(found), dimensions)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([n for n, _ in found], (vectors / np.where(norms > 0, norms, 1)).astype(np.float32), dimensions, seed)


def judge(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """(language, score) of one text."""
    s = space(profiles.dimensions, profiles.seed)
    codes, n = s.counts(text or "")
    if not len(codes) or not profiles.languages:
        return UNKNOWN, 0.0
    v = np.zeros(profiles.dimensions, dtype=np.float32)
    for i in range(0, len(codes), 8192):
        v += n[i:i + 8192].astype(np.float32) @ s.vectors(codes[i:i + 8192])
    cosines = profiles.prototypes @ (v / max(float(np.linalg.norm(v)), 1e-9))
    best = int(cosines.argmax())
    return profiles.languages[best], float(min(max(cosines[best], 0.0), 1.0))


def predict(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score (the cosine, 0 at least). Only the text decides.

    A null text, one without letters, or no learned language gives ``und`` and 0. Equal cosines go to the
    alphabetically first language. Null and repeated keys are rows of their own; other columns are not read.
    """
    def work(pairs: Iterator[tuple[Any, str | None]]) -> Iterable[tuple]:
        for k, t in pairs:
            yield k, *judge(t, profiles)

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, F.col(key), F.col(text), work, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def identified(docs: DataFrame, profiles: Profiles, text: str = "text", least: float | None = None) -> DataFrame:
    """The rows, as they are, whose text is like one of the learned languages: a cosine of ``least`` or more.

    By default that is 1 / sqrt(dimensions), the deviation of the cosine of unrelated text. Null texts, those without letters
    and those in a script or language that no profile was learned from go.
    """
    bound = profiles.dimensions ** -0.5 if least is None else least

    def keep(texts: list[str | None]) -> list[bool]:
        return [name != UNKNOWN and score >= bound for name, score in (judge(t, profiles) for t in texts)]
    return filter_rows(docs, text, lambda: keep)


def held_out(key: Column | str) -> Column:
    """Rows that are never learned from; a null key is not held out."""
    return F.coalesce(crc32_mod(key, FOLDS) == HELD_OUT, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             dimensions: int = DIMENSIONS, seed: int = 7) -> DataFrame:
    """Learns from the rows that are not held out and predicts all: key, held_out, lang_pred, score."""
    profiles = learn(docs.where(~held_out(key)), lang, text, dimensions, seed)
    return predict(docs, profiles, key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
