"""The idempotent append as a stream sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from panelwright.sources.sinks import append_batch


def append_stream(stream: DataFrame, path: str, key: list[str], checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Each micro-batch adds the rows whose key the table lacks (sinks.batches() reads it). A batch is named by the stream, as its
    checkpoint knows it, and its number: one that is done is skipped when it runs again, one that was cut off is written anew. Of
    the table, a batch reads the keys within the range of its own, and with a partition (a column of the key) only its partitions."""

    def add(df: DataFrame, number: int) -> None:
        stream_id = json.loads(df.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        append_batch(df, path, key, f"{stream_id}_{number}", partition)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
