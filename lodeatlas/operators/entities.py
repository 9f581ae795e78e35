"""Entities: the offers of one model by many providers, rolled up."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeatlas.functions import columns as C
from lodeatlas.operators.errors import NotFound

CAPABILITIES = ("reasoning", "tool_call", "attachment", "temperature", "structured_output", "interleaved", "open_weights")


def with_entity(models: DataFrame) -> DataFrame:
    """``models`` with identity modifiers and ``entity_key``; needs family, variant, version, modifier."""
    mods = C.entity_modifiers(F.col("modifier"), F.col("family"))
    return models.withColumn("identity_modifiers", mods).withColumn(
        "entity_key", C.entity_key(F.col("family"), F.col("variant"), F.col("version"), F.col("identity_modifiers"))
    )


_RANGES = ("cost_input", "cost_output", "context_window", "max_output")


def roll_up(models: DataFrame) -> DataFrame:
    """One row per entity, with the aggregates of its offers; no list grows with their number.

    Prices ignore nulls and are null if all are; context and output limits count 0 as a value.
    ``first`` is the smallest (provider, id), by which entities are put in order.
    """
    keyed = with_entity(models)
    flags = [F.bool_or(c).alias(c) for c in CAPABILITIES]
    ranges = [f(c).alias(f"{n}_{c}") for c in _RANGES for n, f in (("min", F.min), ("max", F.max))]
    return keyed.groupBy("entity_key", "family", "variant", "version").agg(
        F.count("*").alias("n_instances"),
        F.min(F.struct("provider", "model_id")).alias("first"),
        F.first("identity_modifiers").alias("identity_modifiers"),
        *ranges,
        *flags,
    )


def entities(models: DataFrame) -> DataFrame:
    """``roll_up`` with the distinct providers and hosts of each entity, in the order of first (provider, id).

    The offers are first aggregated per provider and host, so what is listed for an entity is bounded
    by the number of providers, not of offers; the offers themselves are rows of ``instances``.
    """
    keyed = with_entity(models)
    if "host" not in keyed.columns:
        keyed = keyed.withColumn("host", C.host(F.col("model_id")))
    group = ["entity_key", "family", "variant", "version"]
    small = {f"{n}_{c}": f for c in _RANGES for n, f in (("min", F.min), ("max", F.max))} | {c: F.bool_or for c in CAPABILITIES}
    per_provider = keyed.groupBy(*group, "provider", "host").agg(
        F.count("*").alias("n_instances"), F.min("model_id").alias("model_id"), F.first("identity_modifiers").alias("identity_modifiers"),
        *[f(n if n in CAPABILITIES else n[4:]).alias(n) for n, f in small.items()],
    )
    seen = F.array_sort(F.collect_list(F.struct("provider", "model_id", "host")))
    whole = per_provider.groupBy(*group).agg(
        F.sum("n_instances").alias("n_instances"), seen.alias("_seen"), F.first("identity_modifiers").alias("identity_modifiers"), *[f(n).alias(n) for n, f in small.items()]
    )
    distinct = lambda c: F.array_distinct(F.transform("_seen", lambda s: s[c]))
    return whole.withColumns({"providers": distinct("provider"), "hosts": distinct("host")}).drop("_seen")


def parents(models: DataFrame) -> DataFrame:
    """(entity_key, parent_key, kind, first) of ``models`` with ``parents`` (see ``lineage.attach``): each derivation of an entity once.

    ``first`` is the offer (provider, model_id, place) that names it first, by which parents are put in
    order. Derivations are made distinct before they are shuffled, so a hot entity is one row per parent.
    """
    keyed = with_entity(models).select("entity_key", "provider", "model_id", F.posexplode("parents").alias("place", "p"))
    key = C.entity_key(F.col("p.family"), F.col("p.variant"), F.col("p.version"), F.lit(None).cast("array<string>"))
    each = keyed.select("entity_key", key.alias("parent_key"), F.coalesce("p.kind", F.lit("")).alias("kind"), F.struct("provider", "model_id", "place").alias("first"))
    return each.groupBy("entity_key", "parent_key", "kind").agg(F.min("first").alias("first"))


def with_lineage(entity_rows: DataFrame, models: DataFrame) -> DataFrame:
    """``entity_rows`` with ``lineage``, the distinct (parent_key, kind) of each entity in the order of its offers."""
    listed = parents(models).groupBy(F.col("entity_key").alias("_e")).agg(F.array_sort(F.collect_list(F.struct("first", "parent_key", "kind"))).alias("_l"))
    short = F.transform("_l", lambda x: F.struct(x["parent_key"].alias("parent_key"), x["kind"].alias("kind")))
    joined = entity_rows.join(listed, F.col("entity_key") == F.col("_e"), "left")
    return joined.withColumn("lineage", F.coalesce(short, F.array().cast("array<struct<parent_key:string,kind:string>>"))).drop("_e", "_l")


def instances(models: DataFrame) -> DataFrame:
    """(entity_key, provider, model_id, host, prices and limits): one row per offer."""
    keyed = with_entity(models)
    if "host" not in keyed.columns:
        keyed = keyed.withColumn("host", C.host(F.col("model_id")))
    return keyed.select("entity_key", "provider", "model_id", "host", *_RANGES)


def view(models: DataFrame, key: str) -> dict:
    """An entity with its offers, for display."""
    rows = entities(models).where(F.col("entity_key") == key).collect()
    if not rows:
        raise NotFound("entity", key)
    offers = instances(models).where(F.col("entity_key") == key).orderBy("provider", "model_id")
    return rows[0].asDict(recursive=True) | {"instances": [r.asDict() for r in offers.toLocalIterator()]}


def instances_of(models: DataFrame, key: str) -> DataFrame:
    return with_entity(models).where(F.col("entity_key") == key).orderBy("provider", "model_id")


def parse_entity_tuple(text: str) -> tuple[str, str, str, list[str]]:
    """(family, variant, version, modifiers) of family[/variant[/version]][@version][{a,b}]; a trailing [..] is dropped."""
    text = re.sub(r"\[[^\]]*\]\s*$", "", text.strip())
    mods: list[str] = []
    m = re.search(r"\{([^}]*)\}\s*$", text)
    if m:
        mods, text = [x.strip() for x in m[1].split(",") if x.strip()], text[: m.start()]
    body, at, version = text.rpartition("@")
    if not at:
        body, version = text, ""
    parts = body.split("/")
    if not parts[0]:
        raise NotFound("family", text)
    if not at and len(parts) >= 3:
        version = parts[2]
    return parts[0], parts[1] if len(parts) > 1 else "", version, mods


def entity_by_tuple(models: DataFrame, family: str, variant: str = "", version: str = "", modifiers: list[str] = ()) -> DataFrame:
    """The entity row of a tuple; attribute modifiers do not count."""
    mods = F.array(*[F.lit(m) for m in modifiers]).cast("array<string>") if modifiers else F.lit(None).cast("array<string>")
    key = C.entity_key(F.lit(family), F.lit(variant), F.lit(version), C.entity_modifiers(mods, F.lit(family)))
    return roll_up(models).where(F.col("entity_key") == key)


def lookup_entity(models: DataFrame, argument: str) -> DataFrame:
    """An entity by its tuple, else by the identifier of one of its offers."""
    try:
        found = entity_by_tuple(models, *parse_entity_tuple(argument))
        if not found.isEmpty():
            return found
    except NotFound:
        pass
    row = models.where(F.col("model_id") == argument).orderBy("provider").limit(1)
    return roll_up(models).join(with_entity(row).select("entity_key"), "entity_key", "left_semi")


def providers_for_family(models: DataFrame, raw_family: str) -> DataFrame:
    return models.where(F.col("raw_family") == raw_family).select("provider").distinct().orderBy("provider")


def one_per_group(models: DataFrame, group: list[str], canonical: Column | None = None) -> DataFrame:
    """One row of each group: the publisher's, else the one of the smallest provider and id.

    An aggregate that combines before it shuffles, not a window: a group may hold very many rows.
    """
    canonical = C.canonical_provider(F.col("family")) if canonical is None else canonical
    rank = F.struct((F.col("provider") != canonical).cast("int").alias("other"), "provider", "model_id")
    row = F.struct(*models.columns)
    picked = models.groupBy(*group).agg(F.min_by(row, rank).alias("_row"))
    return picked.select("_row.*")
