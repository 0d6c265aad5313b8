"""Vector retrieval: a set of queries against all rows, in broadcasts of bounded size, one pass over the rows for each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.scores import clamp, cross_lingual, dot, norm
from siftwell.operators import graph
from siftwell.session import cut

MAX_QUERIES = 10_000
FEW = 1 << 16  # rows that are dealt to all cores, as one file may hold them


def over_fetch(k: int) -> dict[str, int]:
    """How many results each channel fetches for a final k."""
    return {"vector": max(2 * k, 6), "bm25": max(2 * k, 6), "entity": max(k, 3), "graph": max(2, k), "seeds": max(2 * k, 4)}


def in_blocks(queries: DataFrame, run: Callable[[DataFrame], DataFrame], most: int = MAX_QUERIES) -> DataFrame:
    """run's result for all queries, which it gets in blocks that may be broadcast."""
    n = queries.count()
    many = -(-n // (most // 2))  # by hash: half of the bound leaves room for uneven blocks
    if n <= most:
        return run(queries)
    return reduce(DataFrame.unionByName, [run(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == k)) for k in range(many)])


def score_all(items: DataFrame, queries: DataFrame, clamped: bool = True) -> DataFrame:
    """(query_id, *items, similarity) of every query with every item; queries: (query_id, embedding as query), a block of a stated set."""
    # Lengths are taken once a vector, not once a pair.
    pairs = items.withColumn("_n", norm(F.col("embedding"))).crossJoin(F.broadcast(queries.withColumn("_q", norm(F.col("query")))))
    sim = F.when(F.col("_n") * F.col("_q") == 0, 0.0).otherwise(dot(F.col("query"), F.col("embedding")) / (F.col("_n") * F.col("_q")))
    return pairs.withColumn("similarity", clamp(sim) if clamped else sim).drop("query", "embedding", "_n", "_q")


def top(scored: DataFrame, score: str, item: str, k: int) -> DataFrame:
    """The first k of each query, ties by id; each partition keeps its own first k before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), item)
    return scored.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def vector_search(items: DataFrame, queries: DataFrame, item: str, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, item, ..., similarity, rank); `where` filters items before they are scored."""
    rows = items if where is None else items.where(where)
    if rows.limit(FEW + 1).count() <= FEW:
        rows = rows.repartition(items.sparkSession.sparkContext.defaultParallelism, item)
    return in_blocks(queries, lambda q: top(score_all(rows, q), "similarity", item, k))


def multilingual(items: DataFrame, queries: DataFrame, item: str, k: int, min_score: float = 0.3, where: Column | None = None) -> DataFrame:
    """Retrieval whose scores are adjusted for language before the threshold; queries: (query_id, query, query_lang), items with lang."""
    rows = items if where is None else items.where(where)

    def run(q: DataFrame) -> DataFrame:
        scored = score_all(rows, q, clamped=False)
        scored = scored.withColumn("score", cross_lingual(F.col("similarity"), F.col("query_lang"), F.col("lang")))
        return top(scored.where(F.col("score") >= min_score), "score", item, k)

    return in_blocks(queries, run)


def graph_channel(entities: DataFrame, vertices: DataFrame, edges: DataFrame, queries: DataFrame, seeds: int, k: int, hops: int = 2) -> DataFrame:
    """(query_id, doc, content, score, channel, rank) from the graph: the entities (id, embedding) nearest each query are the seeds of its search."""
    near = cut(vector_search(entities, queries, "id", seeds).select("query_id", "id", F.col("similarity").alias("score")))
    return graph.result_rows(*graph.search(vertices, edges, near, k, hops))


def confidence(results: DataFrame, score: str = "score") -> DataFrame:
    """The mean score of each query's results; one row (0) in all for no results is left to the caller's join."""
    return results.groupBy("query_id").agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("confidence"))
