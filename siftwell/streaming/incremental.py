"""Streaming extension: BM25 statistics kept up to date batch by batch, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import bm25


def partial_stats(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (n, total) of some documents; both add up over batches."""
    index = bm25.build(docs, doc, text)
    return index.terms.select("term", "df"), index.lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))


def stream_stats(stream: DataFrame, doc: str, text: str, path: str, checkpoint: str):
    """A query that writes each batch's statistics under its batch number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        terms, totals = partial_stats(batch, doc, text)
        terms.write.mode("overwrite").parquet(f"{path}/terms/batch={number}")
        totals.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and (n, avgdl) of all batches written."""
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    corpus = totals.select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("avgdl"))
    df = spark.read.parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", idf.alias("idf")), corpus


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type and tumbling window; the same on a stream, where late rows are dropped after the watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
