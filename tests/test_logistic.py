"""Logistic regression over cells against a Newton solve, whatever the sizes of blocks and ranges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from credence.operators import logistic as L

KIND = "route string, label int, indices array<int>, values array<double>"


def sample(seed, n, width, per_row=6):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=width)
    rows = []
    for i in range(n):
        idx = np.sort(rng.choice(width, rng.integers(0, per_row + 1), replace=False))
        val = np.abs(rng.normal(size=len(idx)))
        if len(idx):
            val /= np.linalg.norm(val)
        p = 1 / (1 + np.exp(-(2 * val @ truth[idx] - 1.0)))
        rows.append((int(rng.random() < p), idx.tolist(), val.tolist()))
    return rows


def newton(rows, width, c):
    x = np.zeros((len(rows), width + 1))
    for i, (_, idx, val) in enumerate(rows):
        x[i, idx], x[i, -1] = val, 1.0
    y = np.array([r[0] for r in rows])
    s = c * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = np.zeros(width + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(np.eye(width + 1) + (x * (s * p * (1 - p))[:, None]).T @ x, b + x.T @ (s * (p - y)))
    return b


def solved(spark, data, strength, tol=1e-15, max_iter=200):
    rows = [(r, *row) for r, (found, _) in data.items() for row in found]
    vectors = spark.createDataFrame(rows, KIND).repartition(3)
    counts = {r: (sum(1 - x[0] for x in found), sum(x[0] for x in found)) for r, (found, _) in data.items()}
    return L.fit(vectors, {r: w for r, (_, w) in data.items()}, counts, strength, max_iter, tol)


def as_vector(weights, ends, route, width):
    got = {r["idx"]: r["weight"] for r in weights.where(f"route = '{route}'").collect()}
    assert sorted(got) == list(range(width))
    return np.array([*[got[i] for i in range(width)], ends[route]])


@pytest.mark.parametrize("rows, columns, together, history", [(16_384, 1 << 15, 64, 16), (7, 5, 2, 3), (1, 4, 1, 1)])
def test_optimum_whatever_the_blocks(spark, monkeypatch, rows, columns, together, history):
    for name, value in (("ROWS", rows), ("COLUMNS", columns), ("CELLS_TOGETHER", together), ("HISTORY", history)):
        monkeypatch.setattr(L, name, value)
    n = 30 if rows == 1 else 120
    data = {"article": (sample(1, n, 21), 21)} if rows == 1 else {"article": (sample(1, n, 37), 37), "claim": (sample(2, 60, 11), 11)}
    weights, ends, iterations = solved(spark, data, {"article": 10.0})
    assert list(ends) == list(data) and min(iterations.values()) > 2
    for route, (found, width) in data.items():
        want = newton(found, width, 10.0 if route == "article" else 1.0)
        assert np.abs(as_vector(weights, ends, route, width) - want).max() < 1e-4


def test_agrees_with_the_library_fit(spark):
    """The same loss through Spark ML: the intercept as a constant column, whose sign differs by row so that it is kept."""
    rows, width, c = sample(5, 300, 60), 60, 10.0
    weights, ends, _ = solved(spark, {"article": (rows, width)}, {"article": c})
    n, n1 = len(rows), sum(r[0] for r in rows)
    flipped = []
    for i, (y, idx, val) in enumerate(rows):
        sign = -1.0 if i % 2 else 1.0
        weight = n / (2 * n1) if y else n / (2 * (n - n1))
        flipped.append((weight, float(y if sign > 0 else 1 - y), Vectors.sparse(width + 1, [*idx, width], [sign * v for v in [*val, 1.0]])))
    fitted = LogisticRegression(weightCol="w", regParam=1 / (c * n), standardization=False, fitIntercept=False, maxIter=500, tol=1e-12).fit(
        spark.createDataFrame(flipped, ["w", "label", "features"]))
    assert np.abs(as_vector(weights, ends, "article", width) - fitted.coefficients.toArray()).max() < 1e-4


def test_iterations_end_and_loss_falls(spark):
    data = {"article": (sample(3, 80, 20), 20)}
    _, _, few = solved(spark, data, {"article": 10.0}, max_iter=2)
    assert few == {"article": 2}
    loose = solved(spark, data, {"article": 10.0}, tol=1e-2)[2]
    tight = solved(spark, data, {"article": 10.0}, tol=1e-12)[2]
    assert loose["article"] < tight["article"]


def test_rows_without_terms_and_one_class(spark):
    rows = [(1, [], []), (0, [], []), (0, [], []), (1, [0], [1.0])]
    weights, ends, _ = solved(spark, {"article": (rows, 2)}, {"article": 1.0})
    assert np.abs(as_vector(weights, ends, "article", 2) - newton(rows, 2, 1.0)).max() < 1e-6
    with pytest.raises(ValueError, match="one class"):
        solved(spark, {"article": ([(1, [0], [1.0])], 1)}, {})


def test_nothing_of_vocabulary_size_comes_to_the_driver(spark, monkeypatch):
    """What is collected are sums per place and one intercept per route."""
    sizes = []
    kind = type(spark.range(1))
    collect = kind.collect

    def spy(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows
    monkeypatch.setattr(kind, "collect", spy)
    width = 3000
    solved(spark, {"article": (sample(4, 90, width), width)}, {}, tol=1e-4)
    assert sizes and max(sizes) <= max(len(L.STEPS), 1 + 4 * (2 * L.HISTORY + 2))


def test_only_columns_that_blocks_share_are_moved(spark, monkeypatch):
    """40 rows in blocks of 5, of which each has 50 columns of its own and one of two that all have: a step moves no
    ranges of coefficients but, per block, the two and the intercept."""
    monkeypatch.setattr(L, "ROWS", 5)
    width = 2 + 40 * 50 + 1_000_000
    rows = [("article", i % 2, [i // 2 % 2, *range(2 + 50 * i, 52 + 50 * i)], [0.5] * 51) for i in range(40)]
    vectors = spark.createDataFrame(rows, KIND).coalesce(1)
    kept = L.blocks(vectors, {"article": width}, {"article": (1.0, 1.0)})
    matrix = L._Matrix(kept, L.widths(vectors, {"article": width}))
    a = L._gradients(L._start(kept), {"article": (None, 0.0)})
    sent = matrix.sent(a)
    assert sum(len(r["x"]) for r in sent.collect()) == 8 * 3 * 8        # blocks, numbers, bytes
    assert sum(len(r["x"]) for r in matrix.added(sent).collect()) == 8 * 3 * 8
    whole = {r["columns"]: np.frombuffer(r["x"]) for r in matrix.columns_of(a).collect()}
    assert len(whole) < 64 and sum(np.count_nonzero(x) for x in whole.values()) <= 2 + 40 * 50 + 1
    matrix.release()
    kept.unpersist()


def test_an_iteration_is_two_jobs(spark, monkeypatch):
    """One for the step and one for the slopes: nothing is staged, listed or added up by another job."""
    monkeypatch.setattr(L, "CHECKPOINT", 100)
    data, sc = {"article": (sample(6, 60, 15), 15)}, spark.sparkContext

    def jobs(iterations):
        sc.setJobGroup(f"fit-{iterations}", "")
        found = solved(spark, data, {"article": 10.0}, max_iter=iterations)[2]
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert found == {"article": iterations}
        return len(sc.statusTracker().getJobIdsForGroup(f"fit-{iterations}"))
    assert jobs(6) - jobs(2) == 2 * (6 - 2)


def test_few_partitions_are_dealt_out_and_blocks_keep_their_rows(spark, monkeypatch):
    """One partition of vectors becomes as many as shuffles have; every block, its state and what it gets have its number."""
    monkeypatch.setattr(L, "ROWS", 5)
    vectors = spark.createDataFrame([("article", i % 2, [i % 3], [1.0]) for i in range(40)], KIND).coalesce(1)
    kept = L.blocks(vectors, {"article": 3}, {"article": (1.0, 1.0)})
    numbers = kept.map(lambda b: b.rows).glom().collect()
    assert len(numbers) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(map(len, numbers)) == 8
    assert all(rows == (part << 32 | i) for part, found in enumerate(numbers) for i, rows in enumerate(found))
    kept.unpersist()
