"""SimHash classes against plain fingerprints and all comparisons."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward, documents, empty, prose

from credence.llm import simhash as S


def plain(text, n=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in found) > len(found))


def plain_components(ids, fps, bits=4):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                label[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO three", "a b c d", "a b c d e f g", "Été ÀB c\x0bd\x0ce\rf", prose(5, 500)])
def test_fingerprints(text, monkeypatch):
    assert S.fingerprint(text) % (1 << 64) == plain(text)
    for size in (1, 7, 100):                    # texts that are cut into slices
        monkeypatch.setattr(S, "SLICE", size)
        assert S.fingerprint(text) % (1 << 64) == plain(text)


def near(rng, fp, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bits, widths", [(4, S.PARTS), (2, S.PARTS), (0, S.PARTS), (3, (32, 32)), (1, (32, 32)), (4, (16, 16, 16, 16))])
def test_links_equal_all_comparisons(spark, monkeypatch, bits, widths):
    monkeypatch.setattr(S, "HOMES", 3)          # anchors become grids
    monkeypatch.setattr(S, "VISITORS", 5)
    monkeypatch.setattr(S, "PAIRS", 50)
    rng = random.Random(bits)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps += [near(rng, centre, 6) for _ in range(rng.choice([1, 3, 12]))]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)
    found = {(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in S.edges(df, bits, widths).collect()}
    assert all(0 < (u ^ v).bit_count() for u, v in found)
    place = {x: i for i, x in enumerate(fps)}
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for u, v in found:
        label[find(place[u])] = find(place[v])
    want = plain_components(list(range(len(fps))), fps, bits)
    assert {frozenset(i for i in label if find(i) == r) for r in label} == {frozenset(i for i in label if want[i] == r) for r in label}


def test_every_anchor_within_reach():
    """Each value has one home; the steps lead to every code word within reach and to no other."""
    for reach in (1, 2):
        flips = S.steps(16, reach)
        code = {v for v in range(1 << 16) if S.syndrome(v) == 0}
        rng = random.Random(reach)
        for v in [0, (1 << 16) - 1] + [rng.getrandbits(16) for _ in range(20)]:
            assert {v ^ e for e in flips[S.syndrome(v)]} == {c for c in code if (c ^ v).bit_count() <= reach}
            assert sum((c ^ v).bit_count() <= 1 and (c ^ v) >> S.HAMMING == 0 for c in code) == 1
    assert [sum(t + 1 for t in S.thresholds(b, p) if t >= 0) for b in range(6) for p in (1, 2, 3, 4)] == [b + 1 for b in range(6) for _ in range(4)]


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, 400).astype(np.uint64), rng.integers(0, 300, 400).astype(np.uint64)
    u, v = S.forest(a, b)
    assert len(u) < len(set(a) | set(b))
    def groups(x, y):
        label = {int(i): int(i) for i in set(a) | set(b)}
        for _ in range(300):
            for i, j in zip(x, y):
                label[int(i)] = label[int(j)] = min(label[int(i)], label[int(j)])
        return label
    assert groups(a, b) == groups(u, v)


def test_near_copies_of_documents(spark):
    base = prose(8, 3000)
    rows = awkward() + [(100 + i, base + " end" * (i % 3), "en", "a", 1) for i in range(6)] + [(120, base.replace(" ", "\n").upper(), None, None, None)]
    got = S.near_copies(documents(spark, rows))
    assert got.columns == ["doc_id", "fp", "component_id"]
    fps = [plain(r[1]) for r in rows]
    want = sorted(((r[0], signed(f), c) for r, f, c in zip(rows, fps, plain_components([r[0] for r in rows], fps))), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert S.near_copies(empty(spark)).collect() == []


def test_hexadecimal(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,), (-(1 << 63),)], "fp long")
    assert [r[0] for r in df.select(S.hexadecimal("fp")).collect()] == ["0" * 16, "f" * 16, "0" * 14 + "ff", "8" + "0" * 15]
