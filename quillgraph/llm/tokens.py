"""Token counts by a public tokenizer, whose vocabulary file is a parameter and stays where it is."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.plans.runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: how the vocabulary's makers cut text before merging bytes
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, key: str, text: str, *kept: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, kept..., n_tokens`` of whole texts; a null text has no tokens."""
    ship(texts.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for b in parts:
            n = [len(encode(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*b.schema.names[1:], "n_tokens"])

    chosen = texts.select(text, key, *kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{schema}, n_tokens bigint")
