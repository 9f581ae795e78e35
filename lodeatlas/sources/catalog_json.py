"""The wire catalog: one JSON document map<provider, {name, models: map<key, model>}>, flattened to rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeatlas.functions import columns as C
from lodeatlas.functions import vocabulary as V
from lodeatlas.operators.errors import CacheMiss

_MODEL = (
    "struct<id:string,name:string,family:string,release_date:string,knowledge:string,reasoning:variant,tool_call:variant,attachment:variant,"
    "temperature:variant,structured_output:variant,open_weights:variant,interleaved:variant,"
    "cost:struct<input:double,output:double,reasoning:double,cache_read:double,cache_write:double>,"
    "limit:struct<context:bigint,output:bigint>,modalities:struct<input:array<string>,output:array<string>>>"
)
_DOCUMENT = f"map<string,struct<name:string,models:map<string,{_MODEL}>>>"
_FLAGS = ("reasoning", "tool_call", "attachment", "temperature", "structured_output", "open_weights")


def flatten(documents: DataFrame, column: str = "value", interleaved_config: bool = True) -> DataFrame:
    """One row per provider and model of each document in ``column``; the catalog's stored columns.

    A missing limit is 0 and a missing price null; a capability that is no boolean is false. Unknown
    modalities are skipped. A document that can't be read gives no rows.
    """
    m = lambda x: F.col(f"m.{x}")
    providers = documents.select(F.explode(F.from_json(F.col(column), _DOCUMENT)).alias("provider", "p"))
    rows = providers.select("provider", F.col("p.name").alias("provider_name"), F.explode("p.models").alias("key", "m"))
    # As JSON text: the string "true" is no boolean.
    flag = lambda x: F.to_json(m(x))
    interleaved = C.capability(flag("interleaved"))
    text = lambda x: F.coalesce(m(x), F.lit(""))
    known = lambda x: F.coalesce(F.filter(m(f"modalities.{x}"), lambda v: v.isin(V.MODALITIES)), F.array().cast("array<string>"))
    return rows.select(
        text("id").alias("model_id"), "provider", "provider_name", text("name").alias("display_name"), text("family").alias("raw_family"),
        F.coalesce(m("limit.context"), F.lit(0)).alias("context_window"), F.coalesce(m("limit.output"), F.lit(0)).alias("max_output"),
        *[C.flexible_bool(flag(f)).alias(f) for f in _FLAGS],
        interleaved["supported"].alias("interleaved"), C.capability_config_text(interleaved["config"]).alias("interleaved_config"),
        *[m(f"cost.{c}").alias(f"cost_{c}") for c in ("input", "output", "reasoning", "cache_read", "cache_write")],
        text("release_date").alias("release_date"), text("knowledge").alias("knowledge"), known("input").alias("modalities_input"), known("output").alias("modalities_output"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a catalog file, one document per file."""
    return flatten(spark.read.text(path, wholetext=True))


def read_cached(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the response that was kept in a folder; ``CacheMiss`` if it is absent or empty."""
    path = Path(folder) / "api_response.json"
    if not path.exists() or not path.stat().st_size:
        raise CacheMiss(str(path))
    return read_catalog(spark, str(path))


def keep_response(folder: str, body: bytes) -> str:
    path = Path(folder) / "api_response.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    return str(path)
