"""Token counts by the vocabulary file of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """`keep` and n_tokens of each row's whole text; null texts have 0 tokens. Nothing is shuffled."""
    if "n_tokens" in keep:
        raise ValueError("rename the column n_tokens first")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            yield b[keep].assign(n_tokens=[len(encode(t)) if t else 0 for t in b["_text"]])

    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(run, f"{kinds}, n_tokens long")
