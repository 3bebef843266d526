"""Documents that arrive as a stream, indexed a micro-batch at a time into a segment store.

A batch becomes one segment, and the manifest that shows the segment also records the batch, so a batch that is
played again after a failure, whole or between writing and commit, adds nothing a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import number_rows
from ..sources.segments import MAX_SEGMENTS, SegmentStore


def ingest(docs: DataFrame, store: SegmentStore, name: str, checkpoint: str, max_segments: int = MAX_SEGMENTS, available_now: bool = False) -> StreamingQuery:
    """Start indexing a stream of docs(path, text, and doc_id if they have ids); name tells the store's streams apart.

    Documents without ids are numbered from 1 within a batch, in the order of path. Documents whose path is visible already are left
    out. available_now: end when all that is there is in.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.where("path IS NOT NULL")
        if "doc_id" not in batch.columns:
            rows = number_rows(rows, "path")
        store.ingest_batch(rows.select("doc_id", "path", "text"), name, number, max_segments)

    writer = docs.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
