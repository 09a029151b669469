"""Phrase collocations against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, empty
from pyspark.sql import functions as F

from credence.llm import collocations as C


def plain(rows, top, least):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = re.findall(r"[^ \t]+", piece)
            for n in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + n] for p, a in candidates.items() for n in range(2, len(p)) for i in range(len(p) - n + 1)
                   if 100 * a >= 80 * f[p[i:i + n]]}
        total = sum(a for p, a in f.items() if len(p) == 1)
        found = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 7))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(1, 30)):
            text += rng.choice([rng.choice(passages), rng.choice(words), rng.choice(words).upper(), "", "Été Straße"]) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\xa0", ";x:y "])
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" . ,", "fr"), ("one", "es")]


@pytest.mark.parametrize("seed, top, least, bits", [(1, 5, 2, 26), (2, 3, 3, 8), (3, 1000, 2, 16), (4, 1, 2, 26)])
def test_phrases_equal_a_plain_count(spark, seed, top, least, bits):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = C.mine(docs, top=top, least=least, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, top, least)


def test_further_trials_and_small_blocks(spark, monkeypatch):
    """Three pairs in a passage, of which one longer phrase survives: the first trial score does not settle the language."""
    calls = []
    grow = C._grow
    monkeypatch.setattr(C, "_grow", lambda *a: calls.append(1) or grow(*a))
    monkeypatch.setattr(C, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(C, "BLOCK_WORDS", 20)
    passages = ". ".join(f"p{i} q{i} r{i} s{i}" for i in range(30))
    rows = [(passages, "en")] * 5 + corpus(9, 30)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = C.mine(docs, top=40, least=2)
    assert sorted(map(tuple, got.collect())) == plain(rows, 40, 2)
    assert len(calls) > 1


def test_bitmaps_agree_with_columns(spark):
    words = ["a", "été", "x" * 50, "w1"]
    df = spark.createDataFrame([("en", a, b) for a in words for b in words], "lang string, a string, b string")
    bits = C.bitmap(df.where("a <> 'w1'"), C.slot("lang", [F.col("a"), F.col("b")], 20), 20)
    import xxhash
    h = {w: np.array([xxhash.xxh64_intdigest(w.encode(), 42)], np.uint64) for w in words}
    for a in words:
        for b in words:
            assert bool(C._has(bits, C.slots("en", h[a], h[b], bits=20))[0]) == (a != "w1")
    assert int(np.unpackbits(bits).sum()) == 12


def test_defined_cases(spark):
    rows = [("A b. a B", "en"), ("a b", "en"), ("a b", None), ("a b", "und"), (None, None), ("", "de")]
    docs = spark.createDataFrame([(i, t, g, None, 0) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("phrase", "words", "a", "score", "salt", "tau"):
        docs = docs.withColumn(name, F.lit(1))
    assert sorted(map(tuple, C.mine(docs, least=2).collect())) == plain(rows, 2000, 2)
    assert C.mine(empty(spark)).collect() == []
    assert C.mine(documents(spark)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_shares_are_exact_beyond_64_bits(spark):
    a = 9 * 10 ** 15
    row = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long").select(
        C._share("a", C._exact("l") + C._exact("r")).alias("s")).first()
    assert row["s"] == 2_000_000 * a // (2 * a + 3)
