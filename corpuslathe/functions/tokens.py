"""Token counts and content hashes (Arrow functions; the libraries are native)."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ENCODING = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(name: str):
    """One encoder for each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, name: str = DEFAULT_ENCODING) -> Column:
    """Tokens of a text under the named public encoding; null stays null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(name).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)


def sample_text(conversation: Column) -> Column:
    """All that a sample's turns say, a turn to a line; calls are no part of it."""
    return F.array_join(F.transform(conversation, lambda t: t["content"]), "\n")


def sample_token_count(conversation: Column, name: str = DEFAULT_ENCODING) -> Column:
    """Tokens of all turns and calls, 4 for each turn and 8 for each call."""

    @F.pandas_udf("long")
    def count(parts: pd.Series) -> pd.Series:
        encode = encoding(name).encode_ordinary
        return pd.Series([sum(len(encode(x)) for x in p if x is not None) for p in parts])

    none = F.array().cast("array<string>")
    calls = lambda t: F.coalesce(F.flatten(F.transform(t["tool_calls"], lambda c: F.array(c["function_name"], c["arguments"]))), none)
    parts = F.flatten(F.transform(conversation, lambda t: F.concat(F.array(t["content"]), calls(t))))
    n_calls = F.aggregate(conversation, F.lit(0), lambda s, t: s + F.coalesce(F.size(t["tool_calls"]), F.lit(0)) * F.when(t["tool_calls"].isNull(), 0).otherwise(1))
    return count(parts) + 4 * F.size(conversation) + 8 * n_calls


def content_hash(content: Column) -> Column:
    """XXH3-64 of the bytes, as a signed long."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        import xxhash

        def one(v):
            h = xxhash.xxh3_64_intdigest(v if isinstance(v, bytes) else v.encode())
            return h - 2**64 if h >= 2**63 else h

        return pd.Series([None if v is None else one(v) for v in values], dtype="Int64")

    return run(content)
