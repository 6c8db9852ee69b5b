"""The pipeline as a stream: each micro-batch is handled like a batch, so a stream's results are those of one batch over all its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from verdigris.sources.hashes import append_observed


def run_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes ``transform`` of each micro-batch below ``path``, in a folder of its own that a repeated batch overwrites; so each input counts once."""

    def handle(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_hashes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends new (content_id, hash) pairs of a stream of observed hashes; a repeated batch adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_observed(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
