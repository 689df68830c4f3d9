"""A sink for Structured Streaming: each micro-batch is one commit, once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalog.store import Session
from ..lake import LakeTable
from ..sources.storage import Files


def query_id(files: Files, checkpoint: str) -> str:
    """The id that Spark gave the query that owns a checkpoint; it stays when the query is started again."""
    return json.loads(files.tail(f"{checkpoint.rstrip('/')}/metadata", 1 << 16))["id"]


def append_stream(table: LakeTable, stream: DataFrame, checkpoint: str, query: str = "stream", **trigger) -> StreamingQuery:
    """Append a stream; ``query`` is only a name for the commits' messages.

    The commit of a batch also writes the batch's number beside the id of the checkpoint's query into the catalog, so a batch that
    is run again after a failure is not added again, whatever snapshots expired meanwhile; streams with checkpoints of their own
    don't meet.
    """
    lake = table.lake

    def write(batch: DataFrame, number: int) -> None:
        own = query_id(Files(lake.spark), checkpoint)
        name = f"{lake.store.prefix}stream_batch"

        def last(s: Session) -> int:
            found = s.rows(f"SELECT batch FROM {name} WHERE query_id = ? AND table_id = ?", own, table.id)
            return found[0]["batch"] if found else -1

        def note(s: Session) -> None:
            s.run(f"DELETE FROM {name} WHERE query_id = ? AND table_id = ?", own, table.id)
            s.insert(name, [{"query_id": own, "table_id": table.id, "batch": number}])

        with lake.store.writing() as s:
            s.run(f"CREATE TABLE IF NOT EXISTS {name} (query_id VARCHAR(64), table_id BIGINT, batch BIGINT)")
            if last(s) >= number:
                return
        with lake.transaction(message=f"stream {query}", extra_info=f"{own}:{number}") as tx:
            tx.table(table.name).append(batch)
            tx.notes.append(note)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
