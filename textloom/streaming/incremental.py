"""Incremental preparation: a file stream whose cleaned, new documents are appended, exactly once over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from textloom.functions import text as T
from textloom.operators.clean import clean


def document_stream(spark: SparkSession, folder: str, schema: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def distinct_documents(stream: DataFrame, mode: str = "basic", min_chars: int = 128) -> DataFrame:
    """Cleaned documents that are kept, each with document_hash; copies are told apart when batches are appended."""
    kept = clean(stream, mode, min_chars=min_chars).filter("drop_reason IS NULL")
    return kept.withColumn("document_hash", T.document_hash(F.col("text")))


def append_new(batch: DataFrame, batch_id: int, output: str, order: list[str]) -> None:
    """Writes the documents of a batch whose hash no earlier batch has, of copies inside the batch the first in order. What
    has been written is the only state, so nothing grows in memory; a batch that runs again writes the same folder anew."""
    from textloom.sources.sinks import exists

    spark = batch.sparkSession
    firsts = batch.groupBy("document_hash").agg(F.min(F.struct(*order)).alias("__first"))
    once = batch.join(firsts, "document_hash").filter(F.struct(*order) == F.col("__first")).dropDuplicates(["document_hash"]).drop("__first")
    if exists(spark, output):
        earlier = spark.read.option("basePath", output).parquet(output)
        if "batch_id" in earlier.columns:
            once = once.join(earlier.filter(F.col("batch_id") < batch_id).select("document_hash"), "document_hash", "left_anti")
    once.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")


def run_available(df: DataFrame, output: str, checkpoint: str, order: list[str] | None = None) -> StreamingQuery:
    """Processes what has arrived and stops; the checkpoint makes the next call go on from there. With order, documents are
    appended without copies, the first in order staying."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if order:
        return writer.foreachBatch(lambda batch, batch_id: append_new(batch, batch_id, output, order)).start()
    return writer.format("parquet").option("path", output).outputMode("append").start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and type under a watermark: an extension, for event tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
