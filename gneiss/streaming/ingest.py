"""Streams: logs that arrive in a folder become tables, and late events join their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.sources import quantum


def ingest_logs(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Starts a query that parses each new log once and appends to the tables under `out`: those of quantum.LOG_TABLES, charges among
    them under their own name, a summary, and the errors of each log."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    logs = files.select(quantum.stem(F.col("path")).alias("mol_id"), F.decode("content", "UTF-8").alias("text"))

    tables = {"charges" if k == "npa_charges" else k: v for k, v in quantum.LOG_TABLES.items() if k != "wide"}
    tables |= {"summary": quantum.summary, "errors": quantum.errors}

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # files are read once for all tables
        for name, parse in tables.items():
            # a batch that runs again overwrites its own folder
            parse(batch).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows; works on streams, where rows later than `late` are left out, and on tables."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
