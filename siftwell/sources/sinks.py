"""Collections and graphs as tables on storage; a rebuild replaces the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import bm25


def rebuild_chunks(chunks: DataFrame, embeddings: DataFrame, path: str) -> None:
    """Write chunks with their embeddings and the BM25 index; an error if there are none or one has no embedding."""
    meta = F.struct(F.coalesce("chunk_type", F.lit("text")).alias("content_type"), F.lit(0).alias("page_num"), F.lit("en").alias("language"), F.lit("").alias("source_file"))
    rows = chunks.join(embeddings.select("id", "embedding"), "id", "left").select("id", F.col("text").alias("document"), "embedding", meta.alias("metadata"))
    # Written beside the old table first: a provider is asked once, and what was written is counted.
    rows.write.mode("overwrite").parquet(f"{path}/chunks-new")
    new = chunks.sparkSession.read.parquet(f"{path}/chunks-new")
    got = new.agg(F.count("*").alias("n"), F.sum(F.when(F.col("embedding").isNull(), 1).otherwise(0)).alias("bare")).first()
    if not got.n or got.bare:
        raise ValueError(f"{got.n} chunks, {got.bare or 0} without an embedding")
    new.write.mode("overwrite").parquet(f"{path}/chunks")
    bm25.build(chunks.sparkSession.read.parquet(f"{path}/chunks"), "id", "document").save(f"{path}/bm25")


def rebuild_entities(entities: DataFrame, embeddings: DataFrame, path: str) -> None:
    """Write entities that have an embedding to the collection of entities, their document being name and description."""
    doc = F.concat_ws(": ", "name", F.coalesce("description", F.lit("")))
    rows = entities.join(embeddings.select("id", "embedding"), "id").select("id", doc.alias("document"), "embedding", F.struct("entity_type").alias("metadata"))
    rows.write.mode("overwrite").parquet(f"{path}/entities")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def collection(spark: SparkSession, path: str, name: str, schema: str = "id string, document string, embedding array<float>") -> DataFrame:
    """A collection, made empty where there is none; one that can't be read is an error."""
    if not exists(spark, f"{path}/{name}"):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def save_graph(vertices: DataFrame, edges: DataFrame, path: str, form: str = "parquet") -> None:
    """The graph's own tables, apart from the collection of entities; form: parquet or json, one object a line."""
    vertices.write.mode("overwrite").format(form).save(f"{path}/graph/vertices")
    edges.write.mode("overwrite").format(form).save(f"{path}/graph/edges")


def save_markdown(blocks: DataFrame, path: str) -> None:
    """One text file a document: its blocks in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "markdown")))
    blocks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["markdown"]), "\n\n").alias("value")).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(path)


def save_state(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def to_json(df: DataFrame) -> DataFrame:
    """Each row as JSON, timestamps in ISO form, embeddings left out."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in ("embedding", "embeddings")])).alias("json"))
