"""An extension: the same rules over files or events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import hits_long, scan
from ..plans.model import Rule


def hits(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules are stateless expressions, so a stream of files gives a stream of hits."""
    return hits_long(scan(stream, rules))


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type counts per tumbling window of ts, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
