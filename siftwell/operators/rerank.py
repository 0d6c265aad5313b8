"""Rerankers over (query_id, query, doc, content, score); model scores come from injected providers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.scores import cosine, minmax

ScoreBatch = Callable[[pd.Series, pd.Series], pd.Series]  # (queries, contents) -> scores


def ranked(df: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    out = df.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def _words(text) -> object:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def fitted(df: DataFrame) -> DataFrame:
    """A column `fit`, the part of `simple` that no old score changes; with it the content isn't needed any more."""
    asked = F.array_distinct(_words(F.col("query")))
    had = F.array_distinct(_words(F.substring("content", 1, 500)))
    overlap = F.size(F.array_intersect(asked, had)) / F.greatest(F.size(asked), F.lit(1))
    length = 1 - F.abs(F.lit(300) - F.regexp_count("content", F.lit(r"\S+"))) / 1000.0
    return df.withColumn("fit", 0.6 * overlap + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), length)))


def simple(df: DataFrame, k: int | None = None) -> DataFrame:
    """0.6 x share of the query's words among the first 500 characters + 0.2 x a length score + 0.2 x the old score."""
    had = "fit" in df.columns
    out = (df if had else fitted(df)).withColumn("score", F.col("fit") + 0.2 * F.col("score"))
    return ranked(out if had else out.drop("fit"), k)


def _model(df: DataFrame, score_batch: ScoreBatch, content: str) -> DataFrame:
    @F.pandas_udf("double")
    def model(q: pd.Series, c: pd.Series) -> pd.Series:
        return score_batch(q, c)

    return df.withColumn("model_score", model(F.col("query"), F.expr(content)))


def llm(df: DataFrame, score_batch: ScoreBatch, k: int | None = None) -> DataFrame:
    """The mean of the old and the model's score; the old one where the model gave none."""
    out = _model(df, score_batch, "content")
    return ranked(out.withColumn("score", F.coalesce((F.col("score") + F.col("model_score")) / 2, "score")).drop("model_score"), k)


def cross_encoder(df: DataFrame, score_batch: ScoreBatch, k: int | None = None) -> DataFrame:
    """Model scores of the first 512 characters, min-max per query."""
    out = _model(df, score_batch, "substring(content, 1, 512)")
    w = Window.partitionBy("query_id")
    lo, hi = F.min("model_score").over(w), F.max("model_score").over(w)
    return ranked(out.withColumn("score", (F.col("model_score") - lo) / (hi - lo + 1e-8)).drop("model_score"), k)


def hybrid(df: DataFrame, primary: Callable[[DataFrame], DataFrame], secondary: Callable[[DataFrame], DataFrame], k: int | None = None) -> DataFrame:
    """0.7 x primary + 0.3 x secondary, the secondary reranking what the primary scored; a missing secondary counts 0.5."""
    first = primary(df).drop("rank")
    second = secondary(first).select("query_id", "doc", F.col("score").alias("second"))
    out = first.join(second, ["query_id", "doc"], "left").withColumn("score", 0.7 * F.col("score") + 0.3 * F.coalesce("second", F.lit(0.5)))
    return ranked(out.drop("second"), k)


def embedding_blend(df: DataFrame, k: int | None = None) -> DataFrame:
    """0.35 x old score + 0.65 x cosine of the columns query_embedding and embedding."""
    return ranked(df.withColumn("score", 0.35 * F.col("score") + 0.65 * cosine(F.col("query_embedding"), F.col("embedding"))), k)


def reranker(kind: str, score_batch: ScoreBatch | None = None) -> Callable[[DataFrame], DataFrame]:
    """A reranker by name: cross-encoder, llm, hybrid, else simple."""
    if kind == "cross-encoder" and score_batch:
        return lambda df: cross_encoder(df, score_batch)
    if kind == "llm" and score_batch:
        return lambda df: llm(df, score_batch)
    if kind == "hybrid" and score_batch:
        return lambda df: hybrid(df, lambda x: cross_encoder(x, score_batch), simple)
    return simple
