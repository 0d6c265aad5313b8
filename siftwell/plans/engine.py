"""The facade: ingest, index, build the graph, answer batches of queries. Each stage reads and writes its own tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import providers
from siftwell.functions.text import detect_language, snippet
from siftwell.operators import bm25, chunking, context, extraction, fusion, graph, render, rerank, retrieval
from siftwell.session import cut
from siftwell.sources import readers, sinks


@dataclass
class Config:
    chunk_tokens: int = 512
    overlap_percent: float = 2.0
    top_k: int = 5
    strategy: str = "weighted_avg"
    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.WEIGHTS))
    reranker: str = "simple"
    dim: int = 64


class HybridEngine:
    """Documents in, ranked passages and answers out; queries come in batches, as a table (query_id, text)."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embed: providers.Embed | None = None, model: Callable[[str], str] | None = None, scores: rerank.ScoreBatch | None = None) -> None:
        self.spark, self.path, self.config = spark, path, config or Config()
        self.embed = embed or providers.hashing_embedder(self.config.dim)
        self.model, self.scores = model or providers.silent_model, scores

    def process_folder(self, path: str, recursive: bool = True) -> DataFrame:
        blocks = readers.folder(self.spark, path, recursive)
        blocks.write.mode("overwrite").parquet(f"{self.path}/blocks")
        return self.spark.read.parquet(f"{self.path}/blocks")

    def ingest(self, blocks: DataFrame) -> DataFrame:
        """Chunk, embed and index blocks (doc_id, pos, type, content, and source if it says how they were made)."""
        source = F.col("source") if "source" in blocks.columns else F.lit(None).cast("string")
        c = chunking.chunks(blocks, "doc_id", "pos", source, "type", "content", self.config.chunk_tokens, self.config.overlap_percent)
        chunks = cut(c.select(F.concat_ws("#", "doc", "chunk_no").alias("id"), "text", "chunk_type"))
        sinks.rebuild_chunks(chunks, chunks.select("id", providers.embedding_column(F.col("text"), self.embed).alias("embedding")), self.path)
        return self.spark.read.parquet(f"{self.path}/chunks")

    def build_graph(self, blocks: DataFrame, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
        """Extract, merge, rank and store the entity graph of blocks (id, content), and the collection of its entities."""
        e, r = extraction.build_graph(blocks, self.model, rounds)
        rows = e.select(F.lit(0).alias("pos"), "entity_name", "entity_type", "description")
        vertices, edges = graph.load(rows, r.select(F.col("src").alias("src_id"), F.col("dst").alias("tgt_id"), "keywords", "weight"))
        vertices, edges = cut(vertices), cut(edges)
        sinks.save_graph(vertices.join(graph.pagerank(vertices, edges), "id", "left"), edges, self.path)
        vertices, edges = readers.knowledge_graph(self.spark, self.path)
        about = F.concat_ws(": ", "name", F.coalesce("description", F.lit("")))
        sinks.rebuild_entities(vertices, vertices.select("id", providers.embedding_column(about, self.embed).alias("embedding")), self.path)
        return vertices, edges

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, query): the queries' vectors, written so that the provider is asked once."""
        return cut(queries.select("query_id", providers.embedding_column(F.col("text"), self.embed).alias("query")))

    def retrieve(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, query, doc, content, score, channels, rank): both channels fused, then reranked."""
        k = k or self.config.top_k
        many = retrieval.over_fetch(2 * k)
        items = self.spark.read.parquet(f"{self.path}/chunks").select(F.col("id").alias("doc"), F.col("document").alias("content"), "embedding")
        index = bm25.Index.load(self.spark, f"{self.path}/bm25")
        v = retrieval.vector_search(items.select("doc", "embedding"), self.asked(queries), "doc", many["vector"]).select("query_id", "doc", F.col("similarity").alias("score"), F.lit("vector").alias("channel"))
        b = bm25.saturated(bm25.search(index, queries, many["bm25"])).select("query_id", "doc", "score", F.lit("bm25").alias("channel"))
        fused = fusion.fuse(v.unionByName(b), self.config.strategy, 2 * k, self.config.weights)
        rows = fused.drop("rank").join(items.select("doc", "content"), "doc").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        return rerank.reranker(self.config.reranker, self.scores)(rows).where(F.col("rank") <= k)

    def retrieve_graph(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, doc, content, score, channel, rank): entities near each query, and the graph around them; none without a graph."""
        k = k or self.config.top_k
        many = retrieval.over_fetch(k)
        if not sinks.exists(self.spark, f"{self.path}/graph/vertices"):
            return self.spark.createDataFrame([], "query_id long, doc string, content string, score double, channel string, rank int")
        entities = sinks.collection(self.spark, self.path, "entities").select("id", "embedding")
        vertices, edges = readers.knowledge_graph(self.spark, self.path)
        return retrieval.graph_channel(entities, vertices, edges, self.asked(queries), many["entity"], many["graph"])

    def query(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, answer, confidence, sources, languages): one row for each query that has results.

        The model answers from the passages and the graph; where it gives nothing, the passages are the answer.
        """
        rows = cut(self.retrieve(queries, k)).withColumn("content_type", F.lit("text"))
        fallback = context.fallback_answer(rows)
        prompts = queries.join(context.prompt_context(rows, self.retrieve_graph(queries, k)), "query_id")
        said = context.generated(prompts.select("query_id", render.answer_prompt(F.col("text"), F.col("context")).alias("prompt")), self.model)
        answers = fallback.join(said, "query_id", "left").select("query_id", F.coalesce("reply", "answer").alias("answer"))
        sources = rows.groupBy("query_id").agg(
            F.avg("score").alias("confidence"), F.array_sort(F.collect_list(F.struct("rank", "doc", F.round("score", 4).alias("score"), snippet(F.col("content")).alias("snippet")))).alias("sources"),
            F.array_sort(F.collect_set(detect_language(F.col("content")))).alias("languages"),
        )
        return answers.join(sources, "query_id")

    def statistics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks").groupBy("metadata.content_type").count()

    def save_state(self, path: str) -> None:
        sinks.save_state(path, statistics=self.statistics())
