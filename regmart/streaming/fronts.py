"""Structured Streaming fronts over the append-only inputs: arriving files and request metrics. Batch stays the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regmart.functions import text
from regmart.operators.metrics import route_metrics as figures
from regmart.sources.store import Store


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of registered files: run_id (the folder that the file lies in), stored_name, sha256, size, uploaded_at, path; each file once, phantoms dropped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    rows = files.filter((F.col("length") > 0) & ~F.lower(F.trim(name)).isin("", "blob"))
    return rows.select(F.element_at(parts, -2).alias("run_id"), text.sanitize_filename(name).alias("stored_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("uploaded_at"), "path")


def register_arrivals(spark: SparkSession, path: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived under ``path`` into the store, runs and files, and ends. Each batch is a part of the store's tables under its own number, written over if it is tried again, so after a
    restart no file is there twice and none is left out."""
    stream = arriving_files(spark, path).writeStream.foreachBatch(lambda batch, number: store.register(batch, number))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route_metrics(requests: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Windowed metrics of a stream of requests (route, duration, status, bytes, ts); rows later than the watermark are left out."""
    grouped = requests.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "route")
    return grouped.agg(*figures()).select(F.col("w.start").alias("window_start"), "*").drop("w")


def route_totals(requests: DataFrame) -> DataFrame:
    """Metrics of a stream of requests by route over all windows so far: running totals and the last request by event time, however late it comes. The state is a row for each route."""
    return requests.groupBy("route").agg(*figures())
