"""Distributed prefix sums: a running total over ordered rows of a group of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeatlas.plans.session import cut


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: Column, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over the rows before this one in its group.

    The rows are range-partitioned by group and order, so a group as large as the table is spread over
    many tasks. Every partition is summed on its own; only one total per partition and group is
    gathered, and added as the offset of that partition. ``order`` must be unique within a group.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.withColumn("_amount", amount).repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part", *group).agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).alias("r")
    same = F.col("r._part") == F.col("o._part")
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    joined = summed.join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._inside") + F.col("o._offset")).alias(out))
