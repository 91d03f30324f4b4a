"""Token sizes of texts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import map_text

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(4)
def encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """(key, kept columns, tokens) of each text; null texts have no tokens."""
    names = [key, *keep]
    types = dict(docs.dtypes)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        n = np.array([len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n)], names=[*names, "tokens"])

    schema = ", ".join(f"`{c}` {'long' if c == key else types[c]}" for c in names) + ", tokens long"
    return map_text(docs.select(F.col(key).cast("long").alias(key), *keep, F.col("text").cast("string").alias("text")), run, schema)
