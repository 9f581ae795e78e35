"""Free-form JSON records, opened into one row per field."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeatlas.plans.session import ship_package

FIELD_SCHEMA = "feed string, file_no bigint, line_no bigint, provider string, id string, path string, parent string, kind string, value bigint, text string"


def json_kind(value: object) -> str | None:
    """The JSON type of a parsed value; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def canonical(value: object) -> object:
    """A form in which equal values are written equally: numbers by value, keys in order."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value if abs(value) < 2**53 else float(value) if abs(value) < 2**1000 else str(value)
    if isinstance(value, float):
        return int(value) if value == value and abs(value) < 2**53 and value.is_integer() else value
    if isinstance(value, list):
        return [canonical(x) for x in value]
    return {k: canonical(v) for k, v in value.items()}


def value_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def clean(text: str) -> str:
    """Lone surrogates can't be written as UTF-8; they become question marks."""
    return text.encode("utf-8", "replace").decode()


def parse_record(payload: str | None) -> dict | None:
    """The object of a line; None for a broken line and for JSON that is no object."""
    try:
        got = json.loads(payload)
    except (ValueError, TypeError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


_KIND = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
_QUOTED = json.encoder.encode_basestring_ascii


def written(value: object) -> str:
    """The canonical value as JSON text."""
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return _QUOTED(value)
    return json.dumps(canonical(value), sort_keys=True)


def fields_of(record: dict) -> Iterator[tuple[str, str, str, str]]:
    """(path, parent, kind, canonical text) of the non-null fields, two levels deep."""
    for key, value in record.items():
        if value is None:
            continue
        yield key, "", _KIND[type(value)], written(value)
        if isinstance(value, dict):
            for k, v in value.items():
                if v is not None:
                    yield f"{key}.{k}", key, _KIND[type(v)], written(v)


def open_fields(records: DataFrame, texts: bool = True) -> DataFrame:
    """One row per non-null field of each readable record of ``records`` (feed, file_no, line_no, provider, payload).

    ``value`` is a hash of the canonical value, ``text`` that value as JSON. Broken lines give no
    rows; a field that is null counts as absent. The id is the record's own ``id`` as text. Without
    ``texts`` the texts are left out.
    """
    ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, paths, parents, kinds, values, held = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(4).to_pylist()):
                record = parse_record(text)
                if record is None:
                    continue
                key = record.get("id")
                key = clean(key if isinstance(key, str) else json.dumps(canonical(key), sort_keys=True))
                for path, parent, kind, value in fields_of(record):
                    at.append(i)
                    ids.append(key)
                    paths.append(path if path.isascii() else clean(path))
                    parents.append(parent if parent.isascii() else clean(parent))
                    kinds.append(kind)
                    values.append(xxhash.xxh64_intdigest(value.encode()) - 2**63 if value.isascii() else value_hash(value))
                    held.append(value)
            rows = pa.array(at, pa.int64())
            texts_ = pa.array(held, pa.string()) if texts else pa.nulls(len(held), pa.string())
            columns = [*(batch.column(k).take(rows) for k in range(4)), *(pa.array(c, pa.string()) for c in (ids, paths, parents, kinds)), pa.array(values, pa.int64()), texts_]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FIELD_SCHEMA.split(", ")])

    picked = records.select("feed", F.col("file_no").cast("bigint"), F.col("line_no").cast("bigint"), "provider", "payload")
    return picked.mapInArrow(run, FIELD_SCHEMA)
