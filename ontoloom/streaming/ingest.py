"""Streaming ingest: new documents are taken over once, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ontoloom.operators import tables as tb
from ontoloom.operators import textprep as tp


def ingest_stream(stream: DataFrame, table: str, checkpoint: str, id_hex: int = 16, once: bool = True) -> StreamingQuery:
    """Append the documents of a stream (doc_id, text) whose content isn't in the Parquet table yet.

    Each micro batch is reduced to its first document per content and held against the table by an anti-join, the streaming form of a resume
    ledger. A batch that is delivered again adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = tp.ingest(batch, id_hex)
        try:
            new = tb.pending(new, spark.read.parquet(table), ["doc_key"])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(table)

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def event_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``start, event_type, n, value``: windowed counts of an event stream with a watermark for late rows."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "value")
