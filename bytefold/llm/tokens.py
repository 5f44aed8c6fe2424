"""Token counts of texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file lies on every machine; a parameter of each operator.
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-split pattern that belongs to the vocabulary file.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocab: str = DEFAULT_VOCAB):
    """The encoder of a vocabulary file, made once in each Python worker."""
    import tiktoken

    with open(vocab, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("bytefold", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], vocab: str = DEFAULT_VOCAB) -> list[int]:
    """The number of tokens of each text; null and empty texts have none."""
    encode = encoder(vocab).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def token_counts(documents: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """``doc_id, n_tokens`` of ``documents(doc_id, text)``, one row for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count_tokens(b.column("text").to_pylist(), vocab), pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id bigint, n_tokens bigint")
