"""Fusion of ranked lists: (query_id, channel, doc, score), one union and one aggregation, no join chains."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.scores import minmax, sigmoid

WEIGHTS = {"vector": 0.5, "bm25": 0.5, "graph": 0.0}
RRF_K = 60


def weights(given: Mapping[str, float]) -> dict[str, float]:
    """Weights that sum to one."""
    total = sum(given.values())
    return {k: v / total for k, v in given.items()} if total and abs(total - 1) > 0.01 else dict(given)


def _weight(given: Mapping[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights(given).items() for x in kv]), F.col("channel")), F.lit(0.0))


def normalize(lists: DataFrame, how: str = "minmax", scale: float = 1.0, k: int = RRF_K) -> DataFrame:
    """A column `norm` by minmax, sigmoid or rank (reciprocal rank), within each query and channel."""
    if how == "sigmoid":
        norm = sigmoid(F.col("score"), scale)
    elif how == "rank":
        norm = 1.0 / (k + F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "doc")))
    else:
        norm = minmax(F.col("score"), "query_id", "channel")
    return lists.withColumn("norm", norm)


def fuse(lists: DataFrame, strategy: str = "weighted_avg", top_k: int = 10, given: Mapping[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """(query_id, doc, score, channels, rank) by weighted_avg, rrf, max or min; another name means weighted_avg."""
    channels = F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels")
    if strategy == "rrf":
        scored, score = normalize(lists, "rank", k=k), F.sum(_weight(given) * F.col("norm"))
    elif strategy in ("max", "min"):
        scored, score = lists, F.max("score") if strategy == "max" else F.min("score")
    else:
        scored, score = normalize(lists, "minmax"), F.least(F.lit(1.0), F.sum(_weight(given) * F.col("norm")))
    fused = scored.groupBy("query_id", "doc").agg(score.alias("score"), channels)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    return fused.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top_k)


def merge_results(results: DataFrame) -> DataFrame:
    """One row per query and document: the best row's content, the greatest score, all channels; channels may be joined by +."""
    split = F.flatten(F.collect_list(F.split("channel", r"\+")))
    return results.groupBy("query_id", "doc").agg(
        F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(split)), "+").alias("channels")
    )
