"""Profiles and the factorization machine: definitions on small inputs, accuracy on rows not learned from."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents, empty

from credence.llm import lang_id, toxicity
from credence.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_trigrams(text, s):
    letters = [int(s.symbol[ord(c)]) for c in text.lower()]
    run = [0]
    for x in letters + [0]:
        if x or run[-1]:
            run.append(x)
    return Counter(zip(run, run[1:], run[2:]))


@pytest.mark.parametrize("slice_", [7, 1 << 20])
def test_trigram_counts(monkeypatch, slice_):
    monkeypatch.setattr(lang_id, "SLICE", slice_)
    s = lang_id.space(64, 1)
    for text in ["", "a", " ab  cd!", "Zwei Wörter, und 12 mehr!", "ééé ñ", "x" * 50]:
        codes, n = s.counts(text)
        got = {(c // 4096, c // 64 % 64, c % 64): k for c, k in zip(codes.tolist(), n.tolist())}
        want = plain_trigrams(text, s) if any(c.isalpha() for c in text) else {}
        assert got == dict(want)


def test_vectors_are_bound_letters_and_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(lang_id, "MEMORY_ROWS", 3)
    s = lang_id.Space(64, 1)
    codes = np.array([64 * 64 * 1 + 64 * 2 + 3, 5, 64, 4096, 70, 4], dtype=np.int32)
    for _ in range(2):
        for c, v in zip(codes.tolist(), s.vectors(codes)):
            a, b, c = (s.third[i] for i in (c // 4096, c // 64 % 64, c % 64))
            assert (v == np.roll(a, 2) * np.roll(b, 1) * c).all()
    assert s.used == 3


def test_identify(spark):
    rows = [(100 + i, "the cat sat on the mat and the dog " * 3, "en", None, None) for i in range(8)]
    rows += [(200 + i, "der hund und die katze auf dem dach " * 3, "de", None, None) for i in range(8)]
    rows += awkward() + [(300, "und der hund", None, None, None), (301, "the dog and", "de", None, None)]
    rows = [r for r in rows if r[0] is None or r[0] < 100 or r[0] >= 300 or r[2]]
    out = lang_id.identify(documents(spark, [r if (r[0] or 0) >= 100 else (r[0], r[1], None, r[3], r[4]) for r in rows]), dimensions=512)
    got = out.collect()
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(rows)
    by_key = {r["doc_id"]: r for r in got}
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert by_key[300]["lang_pred"] == "de" and by_key[100]["lang_pred"] == "en"
    assert {by_key[k]["lang_pred"] for k in (4, 5, 6, 7)} == {"und"} and by_key[4]["score"] == 0.0
    assert lang_id.identify(empty(spark)).count() == 0
    unlearned = lang_id.identify(documents(spark, [(1, "words", None, None, None)])).first()
    assert (unlearned["lang_pred"], unlearned["score"]) == ("und", 0.0)


def test_languages_of_rows_not_learned_from(spark):
    docs = table(spark, SF, "documents")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(10, 4))
    rows = [np.array([0]), np.array([0, 3, 7]), np.array([0, 1, 2, 9])]
    sizes = np.array([len(r) for r in rows])
    z, _ = toxicity.machine(weights, np.concatenate(rows), np.cumsum(sizes) - sizes)
    want = [sum(weights[i, 0] for i in r) + sum(weights[i, 1:] @ weights[j, 1:] for i in r for j in r if i < j) for r in rows]
    assert np.allclose(z, want)


def test_pairs_of_harmless_terms_are_learned():
    """Toxic only where both terms meet; each alone is as common in harmless rows."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(4000):
        a, b = i % 2, i // 2 % 2
        terms = {0, *rng.sample(range(10, 60), 6)} | ({1} if a else set()) | ({2} if b else set())
        rows.append(np.array(sorted(terms), dtype=np.int32))
        labels.append(float(a and b))
    hashes, weights = toxicity.fit_machine(rows, np.array(labels), epochs=30)
    at = {int(h): w for h, w in zip(hashes, weights)}
    z = lambda *t: sum(at[i][0] for i in (0, *t)) + sum(float(at[i][1:] @ at[j][1:]) for i in (0, *t) for j in (0, *t) if i < j)
    assert z(1, 2) > 0 > max(z(1), z(2), z())


def test_pairs_survive_the_decay():
    """Toxic where exactly one of two terms stands, with the settings that ``learn`` uses: no sum of weights does that."""
    rng = random.Random(5)
    rows, labels = [], []
    for _ in range(6000):
        u = rng.random()
        a, b = u < 0.03 or 0.06 <= u < 0.07, 0.03 <= u < 0.07       # 3 % each alone, 1 % both
        rows.append(np.array(sorted({0, *rng.sample(range(10, 60), 6)} | ({1} if a else set()) | ({2} if b else set())), dtype=np.int32))
        labels.append(float(a != b))
    hashes, weights = toxicity.fit_machine(rows, np.array(labels))
    dense = np.zeros((60, weights.shape[1]))
    dense[hashes] = weights
    z = lambda *t: float(toxicity.machine(dense, np.array([0, *t]), np.array([0]))[0][0])
    assert min(z(1), z(2)) > 0 > max(z(), z(1, 2))


def test_no_telling_term_is_left_out():
    """3,000 terms that are in toxic rows only."""
    rows = [np.array([0, *range(10 + i // 2 % 4, 3010, 4)] if i % 2 else [0, 5], dtype=np.int32) for i in range(200)]
    found = toxicity.telling_terms(rows, np.array([float(i % 2) for i in range(200)]))
    assert len(set(found.tolist()) - {0, 5}) > 2_048


def test_term_ids():
    assert toxicity.term_ids("").tolist() == [0]
    assert toxicity.term_ids("Bad, BAD bad!").tolist() == toxicity.term_ids("bad").tolist()
    assert len(toxicity.term_ids("É é x")) == len({0, *toxicity.term_ids("é x").tolist()})
    assert len(toxicity.term_ids("word " * 500_000)) == 3


def labelled(n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 200)}" for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randint(0, 39)] = rng.choice(["idiotxx", "scumxx"])
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, 0, int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_rate(spark):
    docs, labels = labelled()
    extra = [(k + 10_000 if k is not None else None, *r) for k, *r in awkward()]
    odd = [(0, 0, 1), (1, None, None), (None, 1, 1), (99_999, 0, 1)]
    out = toxicity.rate(documents(spark, docs + extra), spark.createDataFrame(labels + odd, LABELS)).collect()
    assert len(out) == len(docs) + len(extra)
    truth = {k: t for k, _, t in labels}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert not any(r["predicted"] for r in out if r["doc_id"] is None or r["doc_id"] >= 9_000)


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 0, 1)], [(1, None, None)]])
def test_too_few_labels(spark, labels):
    out = toxicity.rate(documents(spark), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(awkward()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.rate(empty(spark), spark.createDataFrame(labels, LABELS)).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    sizes = []
    real = toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, name, *a: (sizes.append(name), real(df, name, *a))[1])
    docs, labels = labelled()
    model = toxicity.learn(documents(spark, docs), spark.createDataFrame(labels, LABELS), train_rows=100)
    assert model.columns == ["hash", "weights"] and sizes == ["labels", "toxicity-model"]


def test_balance_does_not_follow_the_size(spark):
    """A word in half of the toxic and a quarter of the clean rows, at 10 % toxic: mostly clean, also where the sample is half toxic."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(4000):
        toxic = i % 10 == 0
        words = [f"w{rng.randint(0, 200)}" for _ in range(10)] + ["maybexx"] * (rng.random() < (0.5 if toxic else 0.25))
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, 0, int(toxic)))
    probe, found = documents(spark, [(1, "maybexx", None, None, None)]), []
    for train_rows in (700, 20_000):
        model = toxicity.learn(documents(spark, docs), spark.createDataFrame(labels, LABELS), train_rows=train_rows)
        found.append(toxicity.score(probe, model).first()["score"])
    assert max(found) < 0.4 and abs(found[0] - found[1]) < 0.15


def test_toxicity_of_rows_not_learned_from(spark):
    out = toxicity.rate(table(spark, SF, "documents"), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id")
    got = out.where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9
