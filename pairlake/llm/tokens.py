"""Sizes of texts in tokens of a public byte-level BPE; the vocabulary's path is a parameter."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def with_token_counts(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns + n_tokens (long); null and empty texts have 0. Whole texts are encoded, JVM rows stay narrow.

    The vocabulary file (under 2 MB, checked) is read on the driver and sent to the executors once.
    """
    raw = Path(vocabulary).read_bytes()
    if len(raw) > 20_000_000:
        raise ValueError("vocabulary file too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(raw)
    pattern = PATTERN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"]
            )

    narrow = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(count, f"{schema}, n_tokens long")
