"""Duplicates hidden by formatting: progressive refinement of a partition of the rows.

All rows start in the classes of a cheap invariant (number of letters and digits, and a fingerprint of
how often each of them occurs). Only the members of classes with several rows get the costly key, the
sorted multiset of words. The invariants are counted before anything is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeatlas.llm.words import WORD
from lodeatlas.plans.session import cut, ship_package
from lodeatlas.plans.skew import salted_join


@F.pandas_udf(T.StringType())
def _unify(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(WORD.findall(unicodedata.normalize("NFKC", t).casefold())))


def _spelled(text: Column) -> Column:
    """Words in lower case with one space between them; only text beyond ASCII leaves the JVM."""
    foreign = text.rlike(r"[^\x00-\x7F]")
    ascii_words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.coalesce(_unify(F.when(foreign, text)), ascii_words)


def copy_classes(rows: DataFrame, key: str, within: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(key, first, n_copies): for each row of a class with several rows the smallest key in it.

    Rows are copies if the columns ``within`` are equal (null equals null) and the columns ``texts``
    together hold the same words equally often; a word is an unbroken run of letters and digits. A
    null text is empty; rows without any word are copies of each other. Rows without a key are left
    out; a key that occurs twice counts as two copies of one row.
    """
    ship_package(rows.sparkSession)
    names = [f"w{i}" for i in range(len(within))]
    text = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts])
    spelled = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(w).alias(n) for w, n in zip(within, names)], _spelled(text).alias("spelled"))
    letters = F.array_join(F.array_sort(F.split(F.regexp_replace("spelled", " ", ""), "")), "")
    cheap = cut(spelled.withColumns({"length": F.length(F.regexp_replace("spelled", " ", "")), "histogram": F.xxhash64(letters)}))
    invariant = [*names, "length", "histogram"]
    several = cheap.groupBy(*invariant).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = salted_join(cheap, several, invariant, ["key"], "left_semi")
    costly = F.sha2(F.array_join(F.array_sort(F.split("spelled", " ")), " "), 256)
    bagged = cut(kept.select("key", *names, costly.alias("bag")))
    classes = bagged.groupBy(*names, "bag").agg(F.min("key").alias("first"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return salted_join(bagged, classes, [*names, "bag"], ["key"]).select("key", "first", "n_copies")


def collapse(rows: DataFrame, key: str, within: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """One row per class of copies, the one with the smallest key, with ``n_copies``."""
    classes = copy_classes(rows, key, within, texts).groupBy(F.col("key").alias("_k")).agg(F.min("first").alias("_first"), F.max("n_copies").alias("_n"))
    joined = rows.join(classes, F.col(key) == F.col("_k"), "left")
    return joined.where(F.col("_first").isNull() | (F.col("_first") == F.col(key))).withColumn("n_copies", F.coalesce("_n", F.lit(1)).cast("bigint")).drop("_k", "_first", "_n")
