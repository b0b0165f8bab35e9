"""Streaming extension: a stream of requests against a static catalogue, idempotent by request id within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from attestry.operators.decide import decide


def resolve_stream(requests: DataFrame, catalog: DataFrame, output: str, checkpoint: str, event_time: str = "at", lateness: str = "1 hour") -> StreamingQuery:
    """Decide each micro-batch set-at-a-time and append it, one folder a batch, so that a retried batch replaces its own output."""
    unique = requests.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["request_id"])

    def batch(df: DataFrame, number: int) -> None:
        decide(df.drop(event_time), catalog).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return unique.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
