"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary of a public byte-level BPE for many languages, as ranks; every worker reads it from here.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text into pieces before merging, as published with that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    """The tokenizer, read once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = encoding(path)
        for batch in batches:
            yield pd.Series([len(tokenizer.encode_ordinary(t)) for t in batch])

    return run


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, *keep: str) -> DataFrame:
    """(doc_id, tokens, *keep) of the documents whose id and text aren't null; of rows repeated under one id the largest size and greatest values."""
    count = F.pandas_udf(_typed(_count(tokenizer)), "bigint")
    sized = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), count("text").alias("tokens"), *keep)
    return sized.groupBy("doc_id").agg(F.max("tokens").alias("tokens"), *(F.max(k).alias(k) for k in keep))


def _typed(run):
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run
