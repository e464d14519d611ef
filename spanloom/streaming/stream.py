"""The per-document operators over streams. They keep no state between rows, so a stream needs no watermark for them; windowed counts do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators import identifiers


def scan_identifiers(stream: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Scored hits of a stream of texts, overlaps included."""
    return identifiers.find(stream, by, text)


def hit_rates(hits: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Hits of each kind and disposition in event-time windows; rows later than ``late`` are left out."""
    return hits.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "kind", "disposition").agg(F.count("*").alias("n"))


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch through a batch plan (folds, joins, assignment); progress is kept in ``checkpoint``, which all nodes must reach."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
