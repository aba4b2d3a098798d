"""Keeping resident columns fresh from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def refresh_from_stream(store: Store, name: str, stream: DataFrame, value: str, checkpoint: str, append: bool = False) -> StreamingQuery:
    """Uploads every micro-batch under `name`: in place of what was there, or with it.

    With `append` each batch is written to a folder of its own beside the
    stream's checkpoint, and the column is read from there: a batch that is
    replayed takes its own place, and the lineage is a scan however many batches
    have come.  An empty batch changes nothing.
    """
    folder = f"{checkpoint.rstrip('/')}/rows"

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select(batch[value].alias("v"))
        if append:
            rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
            rows = batch.sparkSession.read.schema(rows.schema).parquet(folder)
        store.upload(name, rows, "v")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint.rstrip('/')}/state").start()
