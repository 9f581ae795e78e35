"""Normalising catalog rows: decomposition, host, date and lineage of every identifier."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeatlas.functions import columns as C
from lodeatlas.functions import vocabulary as V
from lodeatlas.functions.decompose import decompose, stripped_of_modifiers
from lodeatlas.plans.session import ship_package

PARTS = (
    "family string, variant string, version string, modifier array<string>, clean_id string, reason string, "
    "attempted struct<family:string,variant:string,version:string>"
)
#: Decompositions kept per task, so that a pair that comes again and again is taken apart once.
REMEMBERED = 200_000

_ARROW = pa.struct(
    [
        *[(n, pa.string()) for n in ("family", "variant", "version")],
        ("modifier", pa.list_(pa.string())),
        ("clean_id", pa.string()),
        ("reason", pa.string()),
        ("attempted", pa.struct([("family", pa.string()), ("variant", pa.string()), ("version", pa.string())])),
    ]
)


def _parts(raw: str | None, ident: str | None) -> dict:
    r = decompose(raw, ident)
    return {
        "family": r.family, "variant": r.variant, "version": r.version, "modifier": list(r.modifiers) or None, "clean_id": stripped_of_modifiers(ident or "", r),
        "reason": r.failure, "attempted": dict(zip(("family", "variant", "version"), r.attempted)) if r.attempted else None,
    }


def parts(raw_family: Column, model_id: Column) -> Column:
    """The parts of an identifier as a struct column. Only the two texts leave the JVM, and no row is shuffled."""

    @F.arrow_udf(PARTS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        memo: dict[tuple, dict] = {}
        for raws, idents in batches:
            out = []
            for pair in zip(raws.to_pylist(), idents.to_pylist()):
                hit = memo.get(pair)
                if hit is None:
                    hit = _parts(*pair)
                    if len(memo) < REMEMBERED:
                        memo[pair] = hit
                out.append(hit)
            yield pa.array(out, _ARROW)

    return run(raw_family, model_id)


def normalize(models: DataFrame) -> DataFrame:
    """``models`` with family, variant, version, modifier, date, host and the failure of their decomposition.

    The decomposition depends on (raw_family, model_id) only; a task remembers the pairs it has seen, so
    hot identifiers cost a lookup and nothing is joined back. Null texts count as empty. A failure for
    a known modifier is dropped where modifiers were taken. Columns of these names are replaced.
    """
    ship_package(models.sparkSession)
    names = ["family", "variant", "version", "modifier", "reason", "attempted"]
    rows = models.drop(*names, "date", "host").withColumn("_parts", parts(F.col("raw_family"), F.col("model_id")))
    ident, release = F.coalesce("model_id", F.lit("")), F.coalesce("release_date", F.lit("")) if "release_date" in models.columns else F.lit("")
    opened = rows.select("*", *[F.col(f"_parts.{n}").alias(n) for n in names], F.col("_parts.clean_id").alias("_clean"))
    dropped = (F.col("reason") == V.KNOWN_OVERFLOW) & F.col("modifier").isNotNull()
    return opened.withColumns({"date": C.extract_date(F.col("_clean"), release), "host": C.host(ident), "reason": F.when(~F.coalesce(dropped, F.lit(False)), F.col("reason"))}).drop("_parts", "_clean")


def failures(normalized: DataFrame) -> DataFrame:
    """(raw_id, provider, raw_family, attempted_*, reason) of the rows whose decomposition is reported."""
    return normalized.where("reason is not null").select(
        F.col("model_id").alias("raw_id"), "provider", "raw_family", F.col("attempted.family").alias("attempted_family"), F.col("attempted.variant").alias("attempted_variant"),
        F.col("attempted.version").alias("attempted_version"), F.col("date").alias("attempted_date"), "reason",
    )
