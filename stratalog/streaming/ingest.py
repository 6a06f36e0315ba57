"""Streams into a store, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from stratalog.store import Store


def ingest(stream: DataFrame, store: Store, order: list[str], name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a streaming DataFrame of ``(key, value)`` and order columns, null value = delete.

    A batch becomes runs and one manifest commit that also records its number. After a failure the stream sends the batch
    again; if the commit had happened it is skipped, else nothing of it was visible. ``name`` tells streams apart.
    A row with a null key is refused as in ``write_frame``: its batch fails with nothing of it visible, and the stream ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.write_frame(batch, order, name, number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
