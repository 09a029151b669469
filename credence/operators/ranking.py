"""Running totals and row numbers over groups of any size.

A plain window puts each group into one task. Here every group is cut into ranges of its order
column at approximate quantiles; a window runs inside each range, and the totals of the earlier
ranges (a small table) are added. The result is exact whatever the cut points are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.session import stage

RANGES = 200


def with_ranges(df: DataFrame, group: Sequence[str], order: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``_range``: how many cut points of the row's group lie below its order value."""
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = stage(
        df.groupBy(*group).agg(F.percentile_approx(order, cuts, 10 * ranges).alias("_cuts")), "cuts")
    below = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return df.join(bounds, list(group)).withColumn("_range", below).drop("_cuts")


def running_totals(df: DataFrame, group: Sequence[str], order: str, totals: dict[str, Column],
                   ties: Sequence[str] = ()) -> DataFrame:
    """Adds, per name in ``totals``, the sum over the earlier rows of the group (0 for the first).

    ``order`` is numeric; ``df`` is read three times, so pass a scan or a staged table. Within a
    group, rows equal in ``order`` and ``ties`` have no defined sequence.
    """
    ranged = with_ranges(df, group, order)
    keys = [*group, "_range"]
    per_range = ranged.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        per_range.select(*keys, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in totals]),
        "offsets")
    inside = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, keys)
    for name, value in totals.items():
        out = out.withColumn(name, F.col(f"_off_{name}") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_range", *[f"_off_{n}" for n in totals])


def row_numbers(df: DataFrame, group: Sequence[str], order: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """Row number (from 1) within each group, BIGINT."""
    return running_totals(df, group, order, {name: F.lit(1)}, ties).withColumn(name, F.col(name) + 1)


def sorted_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, kind: str = "int") -> DataFrame:
    """Row number (from 0) within each group, INT or another ``kind``, in an order of columns of any type that is unique in the group.

    The rows are range-partitioned by group and order, numbered inside each part, and shifted by the
    counts of the group's earlier parts (a small table), so no group is sorted in one task.
    """
    parts = stage(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "sorted")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
               .select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    number = (F.col("_off") + F.row_number().over(inside) - 1).cast(kind)
    return parts.join(offsets, [*group, "_part"]).withColumn(name, number).drop("_part", "_off")
