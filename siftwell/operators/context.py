"""Context of a block: its neighbours in document order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.extraction import DONE


# How a source is marked in a prompt, and how many characters of a text and of a graph's row are given.
SOURCE = "[%s-%d] (score=%.4f, source=%s)\n%s"
TEXT_MOST, GRAPH_MOST = 4000, 500


def window(blocks: DataFrame, within: str, order: str, ident: str, kind: str, content: str, size: int = 2, kinds: list[str] | None = None, include_self: bool = False) -> DataFrame:
    """A column `context`: up to `size` blocks before and after, in order; kinds filter after the window."""
    w = Window.partitionBy(within).orderBy(order, ident).rowsBetween(-size, size)
    near = F.collect_list(F.struct(F.col(order).alias("pos"), F.col(ident).alias("id"), F.col(kind).alias("type"), F.col(content).alias("content"))).over(w)
    kept = F.filter(near, lambda b: (F.lit(include_self) | (b["id"] != F.col(ident))) & (b["type"].isin(kinds) if kinds else F.lit(True)))
    return blocks.withColumn("context", kept)


def context_string(source: str, content: str, context: str = "context"):
    """Source header, the block, and the first 200 characters of each neighbour."""
    near = F.array_join(F.transform(context, lambda b: F.concat(F.lit("["), b["type"], F.lit("] "), F.substring(b["content"], 1, 200))), "\n")
    return F.concat_ws("\n", F.concat(F.lit("Source: "), F.coalesce(F.col(source), F.lit(""))), F.col(content), near)


def fallback_answer(results: DataFrame) -> DataFrame:
    """(query_id, answer): each result's type and first 300 characters, by rank."""
    line = F.concat(F.lit("["), F.col("content_type"), F.lit("] "), F.substring("content", 1, 300))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("answer"))


def prompt_context(results: DataFrame, graph: DataFrame, caps: tuple[int, int, int] = (8, 5, 5)) -> DataFrame:
    """(query_id, context): what answers are generated from, texts, entities and relationships each up to its cap.

    results: (query_id, rank, content, score, channels), graph: (query_id, rank, content, score, channel).
    """
    line = F.format_string(SOURCE, F.col("kind"), F.col("rank"), F.col("score"), F.col("channel"), F.col("content"))
    texts = results.select("query_id", F.lit(0).alias("part"), F.lit("Text").alias("kind"), "rank", "score", F.col("channels").alias("channel"), F.substring("content", 1, TEXT_MOST).alias("content"))
    entity = F.col("channel") == "graph/entity"
    around = graph.select("query_id", F.when(entity, 1).otherwise(2).alias("part"), F.when(entity, "Entity").otherwise("Rel").alias("kind"), "rank", "score", "channel", F.substring("content", 1, GRAPH_MOST).alias("content"))
    cap = F.element_at(F.array(*map(F.lit, caps)), F.col("part") + 1)
    rows = texts.unionByName(around).where(F.col("rank") <= cap).select("query_id", F.struct("part", "rank", line.alias("line")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("context"))


def generated(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(query_id, reply): a model's answers to prompts (query_id, prompt); null where it fails or says nothing."""

    def say(prompt: str) -> str | None:
        try:
            reply = model(prompt)
        except Exception:
            return None
        return None if not reply or reply.strip() == DONE else reply

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(say, na_action="ignore")

    return prompts.select("query_id", run(F.col("prompt")).alias("reply"))
