"""Python workers give back what their allocators keep."""

from __future__ import annotations

import numpy as np
import psutil
import pyarrow as pa
import pytest

from credence.operators import memory
from credence.operators.models import strongest_parts


def used():
    return psutil.Process().memory_info().rss / 1e6


@pytest.mark.skipif(memory._trim is None, reason="another C library")
def test_free_memory_is_given_back():
    held = [np.ones(4096) for _ in range(6000)]         # 197 MB in pieces that come from the heap
    last = np.ones(4096)                                # above them, so that the heap can not just shrink
    full = used()
    del held
    memory.release()
    assert used() < full - 150 and last[0] == 1


def test_scoring_gives_back_before_and_after(spark):
    """Before the first and after the last batch of a task, and after every group."""
    seen = []
    keep, memory.release = memory.release, lambda: seen.append(len(out))
    try:
        out = []
        for x in memory.released(lambda items: (2 * i for i in items))([1, 2, 3]):
            out.append(x)
        assert out == [2, 4, 6] and seen == [0, 3]
        table = pa.table({"x": [1]})
        assert memory.released_pairs(lambda left, right: right)(None, table) is table and len(seen) == 3
    finally:
        memory.release = keep
    terms = spark.createDataFrame([(1, 2.0, 0.5, "a"), (1, 1.0, -0.5, "b")], "id long, x double, part double, term string")
    rows = strongest_parts(terms.coalesce(1), "id", 1).collect()
    assert [(r["id"], r["ss"], r["dot"], sorted(e["term"] for e in r["e"])) for r in rows] == [(1, 5.0, 0.0, ["a", "b"])]
