import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from credence.operators.evaluate import OVERALL, confusion_matrix, evaluate, roc_auc, routing_accuracy
from credence.operators.ranking import row_numbers, running_totals
from credence.operators.split import stratified_split


def test_row_numbers_in_a_dominant_group(spark):
    df = spark.range(5_000).select(
        F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") * 7919 % 5003).alias("v"))
    by_group = defaultdict(list)
    for r in df.collect():
        by_group[r["g"]].append(r["v"])
    want = {(g, v): i for g, vs in by_group.items() for i, v in enumerate(sorted(vs), 1)}
    assert {(r["g"], r["v"]): r["rn"] for r in row_numbers(df, ["g"], "v", "rn").collect()} == want


def test_running_totals_count_earlier_rows_only(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 7), ("a", 3.0, 1), ("b", 1.0, 2)], "g string, v double, n int")
    out = running_totals(df, ["g"], "v", {"before": F.col("n")})
    assert {(r["g"], r["v"]): r["before"] for r in out.collect()} == {("a", 1.0): 0, ("a", 2.0): 5, ("a", 3.0): 12, ("b", 1.0): 0}


@pytest.mark.parametrize("counts,size", [((700, 11, 90, 2), 0.2), ((33, 34, 35, 3), 0.25)])
def test_split_is_exact_and_deterministic(spark, counts, size):
    rows = [(f"r{s}-{i}", f"s{s // 2}", s % 2) for s, n in enumerate(counts) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, source string, label int")
    out = {r["id"]: r["is_test"] for r in stratified_split(df, test_size=size).collect()}
    total, tests = sum(counts), math.ceil(size * sum(counts))
    quota = [n * tests // total for n in counts]
    order = sorted(range(len(counts)), key=lambda s: (-(counts[s] * tests % total), s))
    for s in order[: tests - sum(quota)]:
        quota[s] += 1
    want = {}
    for s, n in enumerate(counts):
        ids = sorted((f"r{s}-{i}" for i in range(n)), key=lambda k: (hashlib.md5(f"{k}:42".encode()).hexdigest(), k))
        want |= {k: i < quota[s] for i, k in enumerate(ids)}
    assert out == want and sum(out.values()) == tests


def test_split_rejects_tiny_strata(spark):
    df = spark.createDataFrame([("a", "s", 0), ("b", "s", 0), ("c", "s", 1)], "id string, source string, label int")
    with pytest.raises(ValueError, match="fewer than two"):
        stratified_split(df)


def brute_force(rows):
    n1 = [p for y, p in rows if y == 1]
    n0 = [p for y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in n1 for b in n0) / (len(n1) * len(n0)) if n1 and n0 else None
    c = Counter((y, int(p >= 0.5)) for y, p in rows)
    f = []
    for k in (0, 1):
        tp, fp, fn = c[k, k], c[1 - k, k], c[k, 1 - k]
        if tp + fp + fn:
            f.append(2 * tp / (2 * tp + fp + fn))
    return {"n": len(rows), "accuracy": (c[0, 0] + c[1, 1]) / len(rows), "macro_f1": sum(f) / len(f), "roc_auc": auc}


def test_metrics_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [("m", rnd.choice(["a", "a", "a", "b"]), rnd.randint(0, 1), rnd.choice([0.5, 0.5, rnd.random(), round(rnd.random(), 1)]))
            for _ in range(400)] + [("m", "one-class", 0, 0.3), ("m", "one-class", 0, 0.7)]
    df = spark.createDataFrame(rows, "model string, source string, label int, p double")
    got = {r["scope"]: r for r in evaluate(df).collect()}
    assert sorted(got) == ["a", "b", "one-class", OVERALL]
    for scope, r in got.items():
        want = brute_force([(y, p) for _, s, y, p in rows if scope in (OVERALL, s)])
        for k, v in want.items():
            assert r[k] == (None if v is None else pytest.approx(v, abs=6e-5)), (scope, k)
    matrix = evaluate(df).where("scope = 'one-class'").select(confusion_matrix()).first()[0]
    assert matrix == [[1, 1], [0, 0]] and got["one-class"]["recall"] == 0 and got["one-class"]["roc_auc"] is None


def test_auc_with_one_dominant_score(spark):
    df = spark.range(9_000).select(
        F.lit("m").alias("model"), F.lit("s").alias("source"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 9000).alias("p"))
    rows = [(r["label"], r["p"]) for r in df.collect()]
    below = Counter()
    won, seen0, n0 = 0.0, 0, sum(y == 0 for y, _ in rows)
    for y, p in rows:
        below[p, y] += 1
    for p in sorted({p for _, p in rows}):
        won += below[p, 1] * (seen0 + below[p, 0] / 2)
        seen0 += below[p, 0]
    got = {r["scope"]: r["roc_auc"] for r in roc_auc(df).collect()}
    assert got["s"] == pytest.approx(won / (n0 * (len(rows) - n0)), abs=1e-12) and got["s"] == got[OVERALL]


def test_routing_accuracy(spark):
    df = spark.createDataFrame([("m", "kaggle", "article"), ("m", "liar", "article"), ("m", "new", "article")],
                               "model string, source string, route string")
    assert routing_accuracy(df).first()["routing_accuracy"] == 0.6667
