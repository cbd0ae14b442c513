"""Continuous ingestion: a stream of request bodies appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from emberlog.sources.store import LogStore


def start_ingest(
    requests: DataFrame,
    store: LogStore,
    checkpoint: str,
    source: str,
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Append each micro-batch under (source, batch number).

    A failed or repeated micro-batch is taken up again from the checkpoint and
    either skipped or rewritten whole. There is no watermark: late rows count in
    the second they belong to, whenever they come. Give a new checkpoint a new
    source name. The default trigger commits everything queued, then stops; pass
    {"processingTime": "10 seconds"} to keep going.
    """

    def append(batch: DataFrame, version: int) -> None:
        LogStore(batch.sparkSession, store.root).append(batch, source, version)

    return (
        requests.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
