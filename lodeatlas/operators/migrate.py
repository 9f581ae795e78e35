"""Migrating stored catalogs from older versions of the schema, one step at a time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeatlas.functions import columns as C
from lodeatlas.functions.decompose import split_raw
from lodeatlas.operators.errors import CatalogError
from lodeatlas.plans.session import ship_package

CURRENT = 4


def to_v2(rows: DataFrame) -> DataFrame:
    """The key becomes (model_id, provider); interleaved_config is added. The first row of a key stays."""
    if "interleaved_config" not in rows.columns:
        rows = rows.withColumn("interleaved_config", F.lit(""))
    others = [c for c in rows.columns if c not in ("model_id", "provider")]
    return rows.groupBy("model_id", "provider").agg(F.min(F.struct(*others)).alias("_r")).select("model_id", "provider", "_r.*").select(*rows.columns)


def to_v3(rows: DataFrame) -> DataFrame:
    """family becomes raw_family; family, variant and date are filled. A version stays in the variant."""
    ship_package(rows.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField("family", T.StringType()), T.StructField("variant", T.StringType())]))
    def parts(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_raw(r or "") for r in raw], columns=["family", "variant"])

    renamed = rows.withColumnRenamed("family", "raw_family").withColumn("_p", parts("raw_family"))
    release = F.col("release_date") if "release_date" in rows.columns else F.lit("")
    return renamed.withColumns({"family": F.col("_p.family"), "variant": F.col("_p.variant"), "date": C.extract_date(F.col("model_id"), F.coalesce(release, F.lit("")))}).drop("_p")


def to_v4(rows: DataFrame) -> DataFrame:
    """version is added, empty."""
    return rows if "version" in rows.columns else rows.withColumn("version", F.lit(""))


STEPS: dict[int, Callable[[DataFrame], DataFrame]] = {1: to_v2, 2: to_v3, 3: to_v4}


def migrate(rows: DataFrame, version: int) -> DataFrame:
    """``rows`` of schema ``version`` in the current schema. Version 0 is read as 1."""
    version = max(version, 1)
    if version > CURRENT:
        raise CatalogError(f"schema version {version} is newer than {CURRENT}")
    for v in range(version, CURRENT):
        rows = STEPS[v](rows)
    return rows
