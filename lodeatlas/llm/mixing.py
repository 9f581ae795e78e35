"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are range-sorted by it and the
token counts are summed up by distributed prefix sums, so a source of any size is cut at its exact
budget without gathering it. A source whose budget exceeds its tokens is repeated whole as often as
fits, and the rest is cut from one more epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeatlas.llm.tokens import FOLDER, VOCABULARY, count_tokens
from lodeatlas.plans.prefix import prefix_sums
from lodeatlas.plans.session import cut


def budgets(counted: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """One row per target: tokens there are, tokens wanted, whole epochs and the tokens of the last epoch."""
    there = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    wanted = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    rows = wanted.join(there, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    # One row per target, so one task sums them up.
    total = F.lit(total_tokens) if total_tokens is not None else F.sum("available_tokens").over(Window.partitionBy())
    rows = rows.withColumn("_total", total)
    budget = F.floor(F.col("_total") * F.col("target_share")).cast("bigint")
    reachable = F.least(budget, F.col("available_tokens") * F.col("max_repeats"))
    return (
        rows.withColumns({"budget_tokens": budget, "reachable_tokens": reachable})
        .withColumn("epochs", F.when(F.col("available_tokens") > 0, F.floor(F.col("reachable_tokens") / F.greatest("available_tokens", F.lit(1)))).otherwise(0).cast("bigint"))
        .withColumn("rest", (F.col("reachable_tokens") - F.col("epochs") * F.col("available_tokens")).cast("bigint"))
        .drop("_total")
    )


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str = f"{FOLDER}/{VOCABULARY}"
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, n_tokens, repeats) and the shares reached per source.

    The size of the mixture is ``total_tokens``, by default all tokens of the sources that have a
    target. A source reaches its budget to within its first document that no longer fits, unless
    max_repeats copies of all its documents are less: then it falls short, which the shares report;
    other sources are not stretched to fill in. Documents of no target source (or of none), and
    documents without a token, are not chosen. Repeated rows of an id are documents of their own.
    """
    counted = cut(count_tokens(documents, path=path).where("doc_id is not null and source is not null"))
    plan = cut(budgets(counted, targets, total_tokens))
    keyed = counted.where("n_tokens > 0").withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    summed = prefix_sums(keyed, ["source"], ["key", "doc_id", "n_tokens"], F.col("n_tokens"), "before")
    extra = (F.col("before") + F.col("n_tokens") <= F.col("rest")).cast("bigint")
    chosen = cut(
        summed.join(plan.select("source", "epochs", "rest"), "source").withColumn("repeats", F.col("epochs") + extra).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    )
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    shares = (
        plan.join(reached, "source", "left")
        .withColumn("_whole", F.sum("mixed_tokens").over(Window.partitionBy()))
        .select(
            "source", "target_share", "max_repeats", "available_tokens", "budget_tokens",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("mixed_tokens", "n_documents", "most_repeats")],
            F.coalesce(F.col("mixed_tokens") / F.col("_whole"), F.lit(0.0)).alias("actual_share"),
            (F.col("budget_tokens") - F.col("reachable_tokens")).alias("short_tokens"),
        )
    )
    return chosen, shares
