"""A folder of dropped files as a stream into the record table.

The checkpoint remembers which files were read, so a crash between pick-up and
write reads them again, and the keyed upsert makes the second write harmless.
Rows that cannot be turned into records go to a dead-letter table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import RecordTable

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start(
    spark: SparkSession, folder: str, table: RecordTable, to_records: Callable[[DataFrame], DataFrame], checkpoint: str,
    dead_letters: str, glob: str = "*.pdf", archive: str | None = None, once: bool = False,
    after: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """``to_records`` gives records plus ``error`` (null for good rows);
    ``after`` runs on the whole table once a batch is stored."""
    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if archive:
        source = source.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = to_records(batch).persist()
        try:
            table.upsert(rows.where("error IS NULL").drop("error"))
            rows.where("error IS NOT NULL").write.mode("overwrite").json(f"{dead_letters}/batch={batch_id}")
            if after:
                after(table.read())
        finally:
            rows.unpersist()

    query = source.load(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="30 seconds")).start()
