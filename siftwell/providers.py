"""Backends that queries inject: embeddings, language models, file formats. The stand-ins here are deterministic."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embed:
    """Signed word hashing, unit length: equal on every machine."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), "float32")
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def embedding_column(text: Column, embed: Embed, batch: int = 256) -> Column:
    """Embeddings by a provider, which gets so many texts at a time."""

    @F.pandas_udf("array<float>")
    def run(col: pd.Series) -> pd.Series:
        texts = col.fillna("").tolist()
        return pd.Series([v for k in range(0, len(texts), batch) for v in embed(texts[k : k + batch])], dtype=object)

    return run(text)


def silent_model(prompt: str) -> str:
    """A language model that finds nothing."""
    return "<|COMPLETE|>"


def overlap_scores(queries: pd.Series, contents: pd.Series) -> pd.Series:
    """A reranking model's stand-in: the share of the query's words that the content has."""

    def one(q: str, c: str) -> float:
        asked = set((q or "").lower().split())
        return len(asked & set((c or "").lower().split())) / max(1, len(asked))

    return pd.Series([one(q, c) for q, c in zip(queries, contents, strict=True)], dtype="float64")
