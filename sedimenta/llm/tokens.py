"""Sizes of texts in tokens of a public tokenizer (byte-level BPE ranks in a file whose path is a parameter)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank file, and the pattern that cuts texts into words before merging (a fixed value of that vocabulary).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file; made once per task."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def token_sizes(documents: DataFrame, text: str, keep: list[str], ranks: str = RANKS) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of whole texts; null texts have no size and are left out, empty ones have 0.

    Only the kept columns and a number leave the Python worker, so that no later stage moves texts.
    """
    narrow = documents.select(*keep, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], [*batch.schema.names[: len(keep)], "n_tokens"])

    return narrow.mapInArrow(run, schema)
