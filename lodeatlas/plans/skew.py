"""Joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key from which it is hot, and the share of all rows if that is more.
HOT_ROWS, HOT_SHARE = 20_000, 0.001
#: Parts into which the rows of a hot key are spread.
SALTS = 32


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], salt_by: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``big`` joined with ``small`` on ``keys`` (null equals null), rows of a hot key of ``big`` spread over tasks.

    The rows of each key of ``big`` are counted first, in one aggregation that combines before it
    shuffles. At most 1 / HOT_SHARE keys are hot, so their list may be broadcast. ``small`` is repeated
    for those keys only. ``how`` is "inner", "left" or "left_semi"; columns of ``small`` must not clash.
    """
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = big.count()
    hot = counts.where(F.col("_n") > max(hot_rows, int(total * HOT_SHARE))).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hot"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    marked = lambda df: df.join(F.broadcast(hot), same, "left").drop(*[f"_h{i}" for i in range(len(keys))])
    left = marked(big).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(small).withColumn("_salt2", F.explode(every)).drop("_hot").withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = F.col("_salt") == F.col("_salt2")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(right, on, how).drop("_salt", "_salt2", *[f"_k{i}" for i in range(len(keys))])
