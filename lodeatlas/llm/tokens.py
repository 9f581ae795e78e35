"""Token counts with a public tokenizer. The vocabulary file is read where the task runs."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeatlas.plans.session import ship_package

#: Folder of the vocabulary files and the file used by default.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits a text before byte-pair merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The encoder of a ``.tiktoken`` file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        lines = Path(path).read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(documents: DataFrame, id_column: str = "doc_id", path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(id, source, n_tokens): tokens of the whole text; 0 for null and empty texts."""
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[id_column, "source", "n_tokens"])

    rows = documents.select(F.col(id_column).cast("bigint").alias(id_column), "source", "text")
    return rows.mapInArrow(run, f"{id_column} bigint, source string, n_tokens bigint")
