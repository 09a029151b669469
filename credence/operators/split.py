"""Stratified train/test split with exact stratum sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.schema import SEED, TEST_SIZE
from credence.session import stage

WIDE = "decimal(38,0)"


def stratum_quotas(counts: DataFrame, strata: Sequence[str], test_size: float = TEST_SIZE) -> DataFrame:
    """Test rows per stratum: shares of ceil(test_size * N), the rest by largest remainder."""
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    share = F.col("n").cast(WIDE) * F.col("n_test").cast(WIDE)
    shared = (
        counts.withColumn("total", total).withColumn("n_test", F.ceil(F.lit(test_size) * F.col("total")))
        .withColumn("remainder", F.pmod(share, F.col("total").cast(WIDE)))
        .withColumn("floor_q", ((share - F.col("remainder")) / F.col("total")).cast("bigint")))
    spare = F.col("n_test") - F.sum("floor_q").over(everything)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("remainder"), *strata))
    return shared.select(
        *strata, "n", "total", F.col("n_test").cast("bigint").alias("n_test"),
        (F.col("floor_q") + F.when(place <= spare, 1).otherwise(0)).cast("bigint").alias("quota"))


def stratified_split(df: DataFrame, strata: Sequence[str] = ("source", "label"), test_size: float = TEST_SIZE,
                     seed: int = SEED, key: str = "id") -> DataFrame:
    """Adds ``is_test``: within each stratum the ``quota`` rows with the smallest md5(key:seed).

    Strata may be huge, so no window runs over a whole one: a histogram over the first four hex
    digits finds the slice in which the quota is reached, only that slice is ranked, and the result
    is one cut-off key per stratum. ``df`` is read three times with the strata and key columns only.
    """
    strata = list(strata)
    keyed = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    light = keyed.select(*strata, key, "_hash", F.substring("_hash", 1, 4).alias("_slice"))
    histogram = stage(light.groupBy(*strata, "_slice").agg(F.count("*").alias("c")), "split-histogram")

    quotas = stage(
        stratum_quotas(histogram.groupBy(*strata).agg(F.sum("c").alias("n")), strata, test_size), "split-quotas")
    size = quotas.agg(F.min("n").alias("least"), F.count("*").alias("strata"), F.max("total").alias("total"),
                      F.max("n_test").alias("n_test")).first()
    if size["strata"] == 0:
        raise ValueError("no rows to split")
    if size["least"] < 2:
        raise ValueError("a stratum has fewer than two rows, so it cannot be split")
    if min(size["n_test"], size["total"] - size["n_test"]) < size["strata"]:
        raise ValueError("the test or the train part is smaller than the number of strata")

    upto = F.sum("c").over(Window.partitionBy(*strata).orderBy("_slice"))
    edges = stage(
        histogram.withColumn("upto", upto).join(quotas, strata)
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("c") < F.col("quota")))
        .select(*strata, "_slice", (F.col("quota") - F.col("upto") + F.col("c")).alias("need")),
        "split-edges")
    in_slice = Window.partitionBy(*strata, "_slice").orderBy("_hash", key)
    cutoffs = stage(
        light.join(edges, [*strata, "_slice"]).withColumn("_rn", F.row_number().over(in_slice))
        .where(F.col("_rn") == F.col("need"))
        .select(*strata, F.struct(F.col("_hash").alias("h"), F.col(key).alias("k")).alias("_cut")),
        "split-cutoffs")
    mine = F.struct(F.col("_hash").alias("h"), F.col(key).alias("k"))
    return (keyed.join(cutoffs, strata, "left")
            .withColumn("is_test", F.coalesce(mine <= F.col("_cut"), F.lit(False)))
            .drop("_hash", "_cut"))
