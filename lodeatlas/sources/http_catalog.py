"""Fetching the wire catalog over HTTP, with retries and a size limit; also as a Spark data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from lodeatlas.operators.errors import Unavailable
from lodeatlas.sources.catalog_json import flatten

# Seconds for one request, retries after the first, bytes of a body.
TIMEOUT, RETRIES, MOST_BYTES = 30, 2, 10 * 1024 * 1024


def fetch(url: str, retries: int = RETRIES, timeout: float = TIMEOUT, wait: Callable[[float], None] = time.sleep) -> bytes:
    """The body at ``url``. Each retry waits a second longer; a longer body than allowed can't be read as JSON and fails."""
    reason = ""
    for attempt in range(retries + 1):
        if attempt:
            wait(float(attempt))
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                if answer.status != 200:
                    raise ValueError(f"status {answer.status}")
                body = answer.read(MOST_BYTES)
            json.loads(body)
            return body
        except (OSError, ValueError) as e:
            reason = str(e)
    raise Unavailable(url, retries + 1, reason)


def fetch_models(spark: SparkSession, url: str, provider: str = "", **options) -> DataFrame:
    """The flattened rows at ``url``, of one provider if named."""
    rows = flatten(spark.createDataFrame([(fetch(url, **options).decode(),)], "value string"))
    return rows.where(rows["provider"] == provider) if provider else rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.retries = int(options.get("retries", RETRIES))
        self.timeout = float(options.get("timeout", TIMEOUT))

    def read(self, partition) -> Iterator[tuple]:
        yield (fetch(self.url, self.retries, self.timeout).decode(),)


class CatalogSource(DataSource):
    """``spark.read.format("catalog_http").option("url", ...)``: one row with the document as ``value``."""

    @classmethod
    def name(cls) -> str:
        return "catalog_http"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
