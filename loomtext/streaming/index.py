"""Incremental index maintenance as a Structured Streaming extension: new documents become postings as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators.search import Index, build_index, dictionary


def follow(docs: DataFrame, path: str, checkpoint: str, *, id: str = "doc_id", text: str = "text", available_now: bool = True) -> StreamingQuery:
    """Appends postings and lengths of a stream of documents below path, batch by batch; a batch that runs again writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        index = build_index(batch, id=id, text=text)
        index.postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
        index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def load(spark: SparkSession, path: str) -> Index:
    """The index of all batches so far; totals come from the documents' lengths."""
    docs = spark.read.parquet(f"{path}/docs").drop("batch")
    corpus = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    postings = spark.read.parquet(f"{path}/postings").drop("batch")
    return Index(postings, dictionary(postings), docs, corpus)


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind by window of event time, for batches and streams alike."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    w = e.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), kind, "n")
