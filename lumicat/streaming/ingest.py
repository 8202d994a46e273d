"""Continuous ingest (beyond the batch engine): new file facts are upserted batch by batch.

A batch may run again after a failure; ids that are catalogued already change nothing, so that
leaves the same catalog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lumicat.operators import catalog as K
from lumicat.store import Catalog


def continuous_upsert(catalog: Catalog, stream: DataFrame, checkpoint: str, clock: Callable[[], int], **trigger) -> StreamingQuery:
    """Upsert a stream of photo rows into the catalog, a snapshot for each batch."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        if rows.isEmpty():
            return
        _, after = K.upsert(catalog.read("photos"), rows.select(*K.PHOTO_COLUMNS), clock())
        catalog.commit({"photos": after})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
