"""Streaming form of the run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockloom.operators.registry_tables import run_counters


def counted_stream(spark: SparkSession, folder: str, schema, query: str) -> DataFrame:
    """Counts every event file of a folder with the streaming engine and returns the table so far."""
    stream = run_counters(spark.readStream.schema(schema).parquet(folder))
    running = stream.writeStream.outputMode("complete").format("memory").queryName(query).start()
    running.processAllAvailable()
    running.stop()
    return spark.table(query)
