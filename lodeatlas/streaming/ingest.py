"""Continuous ingest of catalog snapshots: each micro-batch of documents is flattened, normalised and upserted."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodeatlas.operators.merge import CatalogStore
from lodeatlas.operators.normalize import normalize
from lodeatlas.sources.catalog_json import flatten


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def ingest(spark: SparkSession, folder: str, store: CatalogStore, checkpoint: str, now: Callable[[], str] = _now, once: bool = False) -> StreamingQuery:
    """Watch ``folder`` for documents. A batch is one upsert with one stamp; a repeated batch changes nothing but the stamp."""

    def upsert(batch: DataFrame, _: int) -> None:
        rows = normalize(flatten(batch)).drop("attempted", "reason")
        if not rows.isEmpty():
            store.upsert(rows, now())

    writer = spark.readStream.option("wholetext", True).text(folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
