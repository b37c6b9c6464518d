"""Streaming forms: event counts by window with late data, and document frequencies kept up to date. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.operators import bm25
from graniteloom.sources.stores import LOG_SCHEMA, drop_store, replace, versions


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def windowed(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """(start, key, n) of a stream or a table; state is dropped once the watermark passes a window, later rows are ignored."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, stop, key, n): runs of events with no gap as long as ``gap``."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def keep_frequencies(docs: DataFrame, key: str, text: str, path: str, checkpoint: str):
    """Start a stream that keeps the counts under ``path`` current as documents arrive; ``frequencies`` reads them.

    Each batch writes its own counts, as ``path/batches/v<number>``. A batch that is run again writes over what it wrote before, so counts are exact
    for append-only documents, and no batch rewrites the others' counts. ``compact`` sums old batches now and then.
    """

    def add(batch: DataFrame, number: int) -> None:
        bm25.document_frequencies(bm25.term_frequencies(batch, key, text)).write.mode("overwrite").parquet(f"{path}/batches/v{number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) of all batches that are in; none yet, no rows."""
    base = versions(spark, f"{path}/sums")[-1:]
    folders = [f"{path}/sums/v{n}" for n in base] + [f"{path}/batches/v{n}" for n in versions(spark, f"{path}/batches") if not base or n > base[0]]
    kinds = "term string, df bigint"
    rows = spark.read.schema(kinds).parquet(*folders) if folders else spark.createDataFrame([], kinds)
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def compact(spark: SparkSession, path: str) -> None:
    """Sum all batches but the last, which may be run again, into ``path/sums/v<its last batch>``; the summed batches are removed once the sum is whole."""
    done = versions(spark, f"{path}/batches")[:-1]
    base = versions(spark, f"{path}/sums")[-1:]
    new = [n for n in done if not base or n > base[0]]
    if new:
        folders = [f"{path}/sums/v{n}" for n in base] + [f"{path}/batches/v{n}" for n in new]
        rows = spark.read.schema("term string, df bigint").parquet(*folders).groupBy("term").agg(F.sum("df").alias("df"))
        replace(spark, f"{path}/sums", rows, new[-1])
    for n in done:
        drop_store(spark, f"{path}/batches/v{n}")
