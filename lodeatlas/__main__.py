"""Command line: list, show, providers and sync over a catalog file and the store.

    python -m lodeatlas list --catalog api_response.json --output table
    python -m lodeatlas show claude-opus-4-5 --catalog api_response.json
    python -m lodeatlas show --by-entity claude/opus@4.5 --catalog api_response.json --output table
    python -m lodeatlas providers claude/opus@4.5 --catalog api_response.json --output table
    python -m lodeatlas sync --url https://host/api.json
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeatlas.functions.enums import InputFormat, Scheme, parse_output_format
from lodeatlas.operators import entities
from lodeatlas.operators.errors import Ambiguous, CatalogError, NotFound
from lodeatlas.operators.merge import CatalogStore, default_store_path, merge_models
from lodeatlas.operators.normalize import normalize
from lodeatlas.operators.resolve import show
from lodeatlas.plans.render import render, render_ambiguous, render_entity
from lodeatlas.sources.catalog_json import read_catalog
from lodeatlas.sources.http_catalog import fetch_models


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeatlas", description="Query a catalog of AI models.")
    p.add_argument("command", choices=["list", "show", "providers", "sync"])
    p.add_argument("key", nargs="?", default="", help="identifier, reference or entity, for show and providers")
    p.add_argument("--catalog", default="", help="catalog document (.json) or normalised rows (a Parquet folder)")
    p.add_argument("--store", default="", help="folder of the store; by default in the user's cache")
    p.add_argument("--url", default="", help="where sync fetches the catalog")
    p.add_argument("--provider", default="", help="only offers of this provider")
    p.add_argument("--output", default="json", help="json, yaml or table")
    p.add_argument("--format", default=None, help="how the key is written: peasant, huggingface (hf), purl, raw")
    p.add_argument("--scheme", default=None, help="older name of --format")
    p.add_argument("--by-entity", action="store_true", help="show the offers of an entity rolled up")
    return p


def _static(spark: SparkSession, path: str) -> DataFrame:
    if not path:
        raise CatalogError("name a catalog with --catalog")
    rows = normalize(read_catalog(spark, path)) if path.endswith(".json") else spark.read.parquet(path)
    return rows if "last_synced" in rows.columns else rows.withColumn("last_synced", F.lit(""))


def _cached(store: CatalogStore, static: DataFrame) -> DataFrame:
    """The stored rows in the columns of the catalog; none if nothing was stored or the store can't be read."""
    try:
        rows = store.read()
    except Exception:  # noqa: BLE001  a broken store leaves the catalog alone
        rows = None
    if rows is None:
        return static.limit(0)
    there = set(rows.columns)
    return rows.select(*[F.col(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in static.schema.fields])


def _entity(models: DataFrame, key: str, output: str, offers_only: bool) -> str:
    if output == "yaml":
        raise CatalogError("entities are written as json or table")
    found = entities.lookup_entity(models, key).select("entity_key").first()
    if found is None:
        raise NotFound("entity", key)
    e = entities.view(models, found[0])
    if output == "json":
        return json.dumps(e["instances"] if offers_only else e, indent=2, default=str) + "\n"
    text = render_entity(e)
    return f"Entity: {e['entity_key']}\n" + text[text.index("Instances (") :] if offers_only else text


def main(arguments: list[str], spark: SparkSession, out=sys.stdout, err=sys.stderr) -> int:
    a = _parser().parse_intermixed_args(arguments)
    try:
        parse_output_format(a.output)
        store = CatalogStore(spark, a.store or default_store_path(spark))
        if a.command == "sync":
            rows = normalize(fetch_models(spark, a.url, a.provider)).drop("attempted", "reason", "provider_name").cache()
            store.upsert(rows, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
            out.write(render(rows, a.output))
            return 0
        static = _static(spark, a.catalog)
        if a.command == "list":
            # The provider is part of the key, so this filter reaches both scans.
            rows = merge_models(static, _cached(store, static))
            out.write(render(rows.where(F.col("provider") == a.provider) if a.provider else rows, a.output))
        elif not a.key:
            raise CatalogError(f"{a.command} needs a key")
        elif a.command == "providers" or a.by_entity:
            out.write(_entity(static, a.key, a.output, a.command == "providers"))
        else:
            stated = a.format is not None and InputFormat.parse(a.format) is not InputFormat.PEASANT
            scheme = Scheme.parse(a.scheme) if a.scheme and not stated else None
            given = InputFormat.parse(a.format) if stated else None if scheme else InputFormat.PEASANT
            out.write(render(show(static, _cached(store, static), a.key, input_format=given, scheme=scheme), a.output))
        return 0
    except Ambiguous as e:
        err.write(render_ambiguous(e))
    except (CatalogError, ValueError) as e:
        err.write(f"lodeatlas: {e}\n")
    return 1


if __name__ == "__main__":
    from lodeatlas.plans.session import local_session

    sys.exit(main(sys.argv[1:], local_session("*")))
