"""Exact search and the similarity join against brute force."""

import math
import random

import numpy as np
import pytest
from helpers import awkward, documents, empty, prose

from credence.llm import components as C
from credence.llm import jaccard, topk


def brute_top(rows, k, is_query):
    quantized = [(i, n, [math.floor(64 * float(x)) for x in v]) for n, (i, v) in enumerate(rows)
                 if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, q in quantized:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for j, m, v in quantized if m != n)
            out += [(i, rank + 1, j, -s) for rank, (s, j, _) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed, n, dims, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]


EMBEDDING = "vec_id long, embedding array<float>"


def as_float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("name", ["plain", "equal", "awkward", "few", "blocks"])
def test_top_k(spark, monkeypatch, name):
    rows = vectors(3, 700, 8)
    if name == "equal":
        rows = [(i, [0.5, -0.25, 1.0]) for i in range(300)] + [(i + 300, [0.1 * (i % 7), 0.3, -1]) for i in range(100)]
    if name == "awkward":
        rows += [(20, rows[0][1]), (-40, rows[1][1]), (None, rows[2][1]), (800, None), (801, [1.0, None]), (802, [float("nan")] * 8), (803, [float("inf")] * 8),
                 (820, []), (821, [2.0] * 3), (822, [3.0] * 12), (840, [-0.0] * 8)]
    if name == "few":
        rows = rows[:5]
    if name == "blocks":
        monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
        monkeypatch.setattr(topk, "SEEDS", 30)
        monkeypatch.setattr(topk, "ANNULUS", 16)
        monkeypatch.setattr(topk, "PARTITION_ROWS", 100)
    rows = as_float32(rows)
    df = spark.createDataFrame(rows, EMBEDDING).selectExpr("*", "1 AS id", "2 AS row", "3 AS v", "4 AS label", "5 AS dist").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, k=6, pivots=9).collect())
    want = brute_top(rows, 6, lambda i: i % 20 == 0)
    assert got == want
    assert {len(r) for r in got} == {4}


def test_no_vectors(spark):
    assert topk.top_k(spark.createDataFrame([], EMBEDDING)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, None)], EMBEDDING)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], EMBEDDING)).count() == 0


def test_huge_components_do_not_fail(spark):
    out = topk.top_k(spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-3e38, 0.0])], EMBEDDING)).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 2 ** 63 - 1), (2, -2 ** 63)]


def test_annuli_are_skipped():
    """Far away candidates are never multiplied."""
    rng = np.random.default_rng(1)
    near, far = rng.normal(0, 0.1, (50, 4)) + 10, rng.normal(0, 0.1, (500, 4)) - 10
    x = np.vstack([near, far])
    square = float((x ** 2).sum(axis=1).max())
    lifted = np.sqrt(np.maximum(square - (x ** 2).sum(axis=1), 0))
    centres = np.column_stack([x[[0, 60]], lifted[[0, 60]]])
    d = topk.distances(x, lifted, centres)
    pivot, dist = d.argmin(axis=1), d.min(axis=1)
    order = np.lexsort((dist, pivot))

    class Counting(np.ndarray):
        seen = 0

        def __getitem__(self, key):
            Counting.seen += key.stop - key.start if isinstance(key, slice) else 0
            return np.asarray(self)[key]

    q = x[:1]
    s = topk.Shared(np.array([0]), np.array([0]), q, np.array([-np.inf]), topk.distances(q, np.zeros(1), centres), square, 5)
    found = dict(topk.search(s, order, order, pivot[order], dist[order], x[order].view(Counting)))
    scores, ids, _ = found[0].cut()
    assert Counting.seen == 50
    best = sorted(((-float(x[0] @ x[i]), i) for i in range(len(x)) if i))[:5]
    assert ids.tolist() == [i for _, i in best]


# ----------------------------------------------------------------------------- similarity join

def plain_sets(texts, n_words=4):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ")
        for c in "\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        m = min(n_words, len(w))
        out.append({tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if m else set())
    return out


def plain_join(rows, n_words=4, threshold=(85, 100)):
    """(key, size, component) per row."""
    sets = plain_sets([t for _, t in rows], n_words)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and threshold[1] * both >= threshold[0] * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(map(str, ((k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows))))


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(seed, groups, size, length, changes, passage=0):
    rng = random.Random(seed)
    shared = prose(999, 60)
    rows = []
    for g in range(groups):
        base = prose(seed * 1000 + g, rng.randint(length // 2, length)).split()
        for _ in range(rng.randint(1, size)):
            text = edited(rng, base, rng.randint(0, changes))
            rows.append(shared + " " + text if rng.random() < passage else text)
    rng.shuffle(rows)
    return [(i * 3 - 20, t) for i, t in enumerate(rows)]


def joined(df, **options):
    out = jaccard.join(df, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "keep", "text_hash"]
    return out.collect()


def compare(spark, rows, n_words=4, threshold=(85, 100), **options):
    got = joined(documents(spark, [(*r, None, None, None) for r in rows]), n_words=n_words, threshold=threshold, **options)
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == plain_join(rows, n_words, threshold)
    return got


def test_awkward_documents(spark):
    rows = [r[:2] for r in awkward()]
    got = compare(spark, rows)
    kept = [r for r in got if r["keep"] and r["n_shingles"]]
    assert len({(r["doc_id"], r["text_hash"]) for r in kept}) == len({r["component_id"] for r in kept}) 
    assert joined(empty(spark)) == []


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"common": 3, "part_classes": 4}), (3, {"common": 1, "part_classes": 3})])
def test_join_equals_brute_force(spark, seed, options):
    rows = corpus(seed, 25, 8, 80, 5, passage=0.3) + [(10_000 + i, f"a b c d e f g h {i % 3}") for i in range(12)] + [(20_000, "a b c d e f g h 0")] * 2
    compare(spark, rows, **options)


def test_other_words_and_threshold(spark):
    compare(spark, corpus(5, 20, 6, 70, 4), 5, (80, 100), common=4, part_classes=5)


def test_chain_of_near_copies_in_many_parts(spark):
    """Each text links with its neighbours only; the block is cut into parts, so most links are found in the second round."""
    words = prose(8, 400).split()
    rows = [(i, " ".join(words[3 * i:3 * i + 80])) for i in range(100)]
    got = compare(spark, rows, part_classes=7)
    assert {r["component_id"] for r in got} == {0}


def test_long_lists_become_common(spark, monkeypatch):
    """N-grams that no window saw often enough are found when their lists turn out long."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 5)
    monkeypatch.setattr(jaccard, "WINDOW", 50)
    compare(spark, corpus(6, 6, 30, 60, 3), common=5)


def test_texts_of_chosen_classes_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    compare(spark, corpus(7, 10, 5, 60, 3))


@pytest.mark.parametrize("seed", range(4))
def test_links_connect_what_pairs_connect(seed):
    rng = random.Random(seed)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(0, 30))), dtype=np.uint64) for _ in range(60)]
    sets += [np.arange(10, dtype=np.uint64)] * 2

    def groups(pairs):
        parent = list(range(len(sets)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a, b in pairs:
            parent[root(a)] = root(b)
        return [min(j for j in range(len(sets)) if root(j) == root(i)) for i in range(len(sets))]

    def similar(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return both and 10 * both >= 6 * (len(sets[a]) + len(sets[b]) - both)

    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if similar(a, b)]
    assert groups(jaccard.links(sets, None, (6, 10))) == groups(pairs)
    ask = np.array([rng.random() < 0.4 for _ in sets])
    assert groups(jaccard.links(sets, ask, (6, 10))) == groups([p for p in pairs if ask[p[0]] or ask[p[1]]])


@pytest.mark.parametrize("slice_", [5, 1 << 22])
def test_shingles_of_slices(monkeypatch, slice_):
    monkeypatch.setattr(jaccard, "SLICE", slice_)
    texts = ["a b c d", "A  B\tC\nd", "b a c d", "one two", "two one", "onetwo", "é É x y z", "x" * 40 + " b c d e"]
    sets = [tuple(jaccard.shingles(t.encode()).tolist()) for t in texts]
    assert sets[0] == sets[1] and len(set(sets)) == len(texts) - 1 and [len(s) for s in sets] == [1, 1, 1, 1, 1, 1, 2, 2]
    monkeypatch.undo()
    assert sets == [tuple(jaccard.shingles(t.encode()).tolist()) for t in texts]


def test_bounds():
    for a in range(1, 80):
        assert jaccard.prefix_length(a) == a - math.ceil(0.85 * a - 1e-9) + 1
        for b in range(1, 80):
            t = next((i for i in range(min(a, b) + 1) if 100 * i >= 85 * (a + b - i)), None)
            assert t is None or jaccard.least_overlap(a, b) == t


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 300)] + [(-5, 7), (7, -5), (9, 9), (None, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in list(parent)}
    got = C.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
