"""Point lookups and filters over the catalog. Rows come in the order of provider and id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeatlas.functions import columns as C
from lodeatlas.operators.errors import CatalogError, NotFound

REFERENCE = ("model_id", "provider", "raw_family", "family", "variant", "version", "date")


def reference(models: DataFrame) -> DataFrame:
    """The columns that name a model."""
    extra = [c for c in ("modifier", "host") if c in models.columns]
    return models.select(*REFERENCE, *extra)


def by_id(models: DataFrame, ident: str) -> DataFrame:
    """All offers of an identifier; none is no error."""
    return models.where(F.col("model_id") == ident)


def one_by_id(models: DataFrame, ident: str) -> DataFrame:
    """The offer of the smallest provider."""
    return by_id(models, ident).orderBy("provider").limit(1)


def get(models: DataFrame, ident: str) -> dict:
    rows = one_by_id(models, ident).collect()
    if not rows:
        raise NotFound("model", ident)
    return rows[0].asDict(recursive=True)


def by_provider_and_id(models: DataFrame, provider: str, ident: str) -> DataFrame:
    return models.where((F.col("provider") == provider) & (F.col("model_id") == ident))


def by_provider(models: DataFrame, provider: str = "") -> DataFrame:
    """Offers of a provider; all for an empty one."""
    return models.where(F.col("provider") == provider) if provider else models


def by_raw_family(models: DataFrame, raw_family: str) -> DataFrame:
    return models.where(F.col("raw_family") == raw_family)


def by_canonical(models: DataFrame, family: str = "", variant: str = "", version: str = "", date: str = "") -> DataFrame:
    """All given parts equal; an empty part matches anything."""
    for name, value in (("family", family), ("variant", variant), ("version", version), ("date", date)):
        if value:
            models = models.where(F.col(name) == value)
    return models


def scan(models: DataFrame, only: Sequence[str] = (), without: Sequence[str] = (), required: bool = False) -> DataFrame:
    """Offers of some providers, or of all but some; both at once is an error.

    With ``required`` it is an error too if none of the named providers has an offer.
    """
    if only and without:
        raise CatalogError("give providers to take or providers to leave out, not both")
    if only:
        rows = models.where(F.col("provider").isin(list(only)))
        if required and rows.isEmpty():
            raise CatalogError(f"no offers of {', '.join(only)}")
        return rows
    return models.where(~F.col("provider").isin(list(without))) if without else models


def with_names(models: DataFrame) -> DataFrame:
    """``models`` with host, canonical provider and canonical form."""
    date = F.col("date")
    form = C.canonical_form(F.col("provider"), F.col("model_id"), F.col("family"), F.col("variant"), F.col("version"), date, F.col("modifier"))
    return models.withColumns({"host": C.host(F.col("model_id")), "canonical_provider": C.canonical_provider(F.col("family")), "canonical": form})
