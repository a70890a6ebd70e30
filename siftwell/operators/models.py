"""Pluggable models as Arrow functions, with deterministic defaults that need no download."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import ship

_TOKEN = re.compile(r"[^\W_]+")


@functools.lru_cache(maxsize=1 << 18)
def _slot(word: str, dim: int) -> int:
    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
    return (h >> 1) % dim + dim * (h & 1)


def hashed_embedding(texts: list[str], dim: int = 256) -> list[np.ndarray | None]:
    """Signed hashing of lower-cased tokens, L2-normalised; None for texts without a token."""
    out: list[np.ndarray | None] = []
    for t in texts:
        # numbers of 0 to 2 dim - 1: a place, and its sign in the upper half
        found = np.fromiter((_slot(w, dim) for w in _TOKEN.findall((t or "").lower())), np.int64)
        both = np.bincount(found, minlength=2 * dim).astype(float)
        v = both[:dim] - both[dim:]
        size = np.sqrt(v @ v)
        out.append((v / size).astype(np.float32) if size else None)
    return out


def embedder(model: Callable[[list[str]], list] = hashed_embedding, instructions: dict[str, str] | None = None):
    """A function (df, text_col, task) -> df with ``embedding``; ``instructions`` gives each task's prefix."""
    prefix = {"passage": "", "query": ""} | (instructions or {})

    def embed(df: DataFrame, text_col: str, task: str = "passage") -> DataFrame:
        ship(df.sparkSession)
        schema = df.drop("embedding").schema.add("embedding", T.ArrayType(T.FloatType()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["embedding"] = model([prefix[task] + (t or "") for t in pdf[text_col]])
                yield pdf[schema.names]

        return df.drop("embedding").mapInPandas(run, schema)

    return embed


def overlap_reranker(pairs: DataFrame, query_col: str = "query", content_col: str = "content") -> DataFrame:
    """The default reranker: the share of a query's distinct tokens that the content has, as ``score`` in [0, 1]."""
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", -1), ""))
    asked = tokens(query_col)
    return pairs.withColumn("score", F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokens(content_col))).cast("double"), F.size(asked).cast("double")), F.lit(0.0)))
