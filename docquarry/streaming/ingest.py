"""A stream of documents into a store: each micro-batch is the same upsert, so a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docquarry.plans.store import Store


def stream_into(store: Store, incoming: DataFrame, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Starts ingesting incoming, a streaming DataFrame with file_path and text (and file_hash, metadata, tags)."""

    def upsert(batch: DataFrame, _: int) -> None:
        store.ingest(batch, **options).count()

    writer = incoming.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watch_files(store: Store, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Ingests the text files that are in a folder and, if it isn't only what is available now, that come to it."""
    files = store.spark.readStream.format("text").option("wholetext", "true").load(folder)
    return stream_into(store, files.selectExpr("_metadata.file_path as file_path", "value as text"), checkpoint, **options)
