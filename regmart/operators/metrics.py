"""Metrics of requests by route, for tables and for streams alike: every figure is a partial aggregate, so a hot route is summed up where its rows lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regmart.functions.numbers import money


def route_metrics() -> list[Column]:
    """Figures over requests (duration, status, bytes, ts): counts, mean, greatest and last values. The last request is the one of the greatest ts; of several at once the one of the greatest duration, status and bytes."""
    last = F.struct("ts", "duration", "status", "bytes")
    mean = lambda total: F.round(total / F.count("*"), 2)
    return [
        F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("errors"), mean(money(F.col("duration")).cast("double")).alias("avg_duration"), F.max("duration").alias("max_duration"),
        F.max_by("duration", last).alias("last_duration"), F.max("bytes").alias("max_bytes"), F.max_by("bytes", last).alias("last_bytes"), F.max_by("status", last).cast("int").alias("last_status"), F.max("ts").alias("last_seen"),
    ]
